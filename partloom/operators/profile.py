"""Column-level data quality profile: nulls, distinct values, ranges, forms and departures between loads.

Method: the expression of a column is induced by minimum description length over all its distinct values
(`induce_forms`); values that no shape of the chosen level describes more cheaply than spelling them out do not
conform, and coverage is compared between loads (`form_coverage`) alongside the standard aggregates.
Where a form is declared for a column (`Column.form`), it labels the values the expression is induced from
(`agreed_forms`): left to itself an induced expression follows what is frequent, also when what is frequent is
wrong. The values no part of that expression is true for are bad (`conforming`, `load_profile`).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.keys import key
from partloom.session import Cuts


@dataclass(frozen=True)
class Column:
    """A column to profile. form: expression over the string value that is true for values of right form; kind: text, code or number."""

    name: str
    kind: str
    form: str | None = None


@dataclass(frozen=True)
class Limits:
    """Limits of departure from the feed's median; as stated for the feeds of parts."""

    nulls: float = 0.103
    pattern: float = 0.103
    distinct: float = 0.49
    shift: float = 1.47
    mix: float = 0.303


def latest_rows(rows: DataFrame, feed: str, load: str, part: str, seen_at: str, columns: list[str]) -> DataFrame:
    """(feed, load_no, <columns as strings>): per feed, load and part the row with the latest time.

    Rows without a part key are rows of their own. Of rows with the same latest time the one with the greatest values counts.
    """
    values = [F.col(c).cast("string").alias(c) for c in columns]
    slim = rows.select(F.col(feed).alias("feed"), F.col(load).cast("long").alias("load_no"), key(part).alias("k"), F.col(seen_at).alias("t"), *values)
    keyed = slim.where("k is not null").groupBy("feed", "load_no", "k").agg(F.max(F.struct("t", *columns)).alias("m")).select("feed", "load_no", *[F.col(f"m.{c}").alias(c) for c in columns])
    return keyed.unionByName(slim.where("k is null").distinct().select("feed", "load_no", *columns))


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feed, load_no, column_name, value, n): one row per distinct value; blank counts as null, null is a row of its own.

    All that follows works on these counts, so expressions are tried once per distinct value and a value that
    fills a third of the rows is counted before it is shuffled.
    """
    long = rows.select("feed", "load_no", F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(key(c).isNotNull(), F.col(c)).alias("value")) for c in columns])))
    return long.groupBy("feed", "load_no", "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


_LOAD = ["feed", "load_no", "column_name"]


def weighted_median(rows: DataFrame, by: list[str], x: str, w: str, out: str) -> DataFrame:
    """(by, out): the median of x, each value counted w times; of an even number the mean of the middle two.

    Values are totalled by ordered bins of x first; only the bins that hold the middle are looked into, so a group of very many
    distinct values is never gathered.
    """
    size = F.abs(F.col(x).cast("double"))
    binned = rows.withColumn("_bin", (F.signum(F.col(x).cast("double")) * F.floor(F.log2(size + 1) * 256)).cast("long"))
    bins = binned.groupBy(*by, "_bin").agg(F.sum(w).alias("_n"))
    group = Window.partitionBy(*by)
    upto = F.sum("_n").over(group.orderBy("_bin"))
    ranked = bins.withColumn("_all", F.sum("_n").over(group)).withColumn("_before", upto - F.col("_n")).withColumn("_lo", F.expr("(_all + 1) div 2")).withColumn("_hi", F.expr("_all div 2 + 1"))
    middle = ranked.where("_before < _hi and _before + _n >= _lo").select(*by, "_bin", "_before", "_lo", "_hi")
    near = binned.join(middle, [*by, "_bin"]).groupBy(*by, "_bin", "_before", "_lo", "_hi", x).agg(F.sum(w).alias("_n"))
    at = near.withColumn("_to", F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_bin").orderBy(x)))
    first = lambda rank: F.min(F.when(F.col("_to") >= F.col(rank), F.col(x)))
    return at.groupBy(*by).agg(((first("_lo") + first("_hi")) / 2).cast("double").alias(out))


def _right(columns: list[Column]) -> Col:
    """Whether a value is not null and of its column's declared form; any value is where none is declared."""
    right = reduce(lambda e, c: e.when(F.col("column_name") == c.name, F.expr(c.form) if c.form else F.lit(True)), columns, F.when(F.lit(False), True))
    return F.coalesce(F.when(F.col("value").isNotNull(), right), F.lit(False))


def load_profile(counts: DataFrame, columns: list[Column], fits: str | None = None) -> DataFrame:
    """(feed, load_no, column_name, n, nulls, bad, distinct, centre, low, high): shares per feed, load and column.

    bad: non-null values of wrong form, which is told by the column `fits` of counts (`conforming`) or else by the declared
    form; 0 where none is declared. centre: mean length of texts, median of numbers of right form (0 if none), null for
    codes. low and high: smallest and largest non-null value (numbers by value).
    """
    ok = F.col(fits) if fits else _right(columns)
    numbers, texts = [c.name for c in columns if c.kind == "number"], [c.name for c in columns if c.kind == "text"]
    some = F.col("value").isNotNull()
    number = F.when(F.col("column_name").isin(numbers), F.expr("try_cast(value as double)"))
    per = counts.withColumn("ok", ok).withColumn("x", number).groupBy("feed", "load_no", "column_name").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(some, 0).otherwise(F.col("n"))).alias("n_null"),
        F.sum(F.when(some & ~F.col("ok"), F.col("n")).otherwise(0)).alias("n_bad"),
        F.count("value").alias("n_distinct"),
        F.sum(F.when(some, F.length("value") * F.col("n"))).alias("length"),
        F.min("value").alias("low_text"), F.max("value").alias("high_text"), F.min("x").alias("low_x"), F.max("x").alias("high_x"),
    )
    weighed = counts.withColumn("ok", ok).withColumn("x", number).where("ok and x is not null").select(*_LOAD, "x", F.col("n").alias("w"))
    per = per.join(weighted_median(weighed, _LOAD, "x", "w", "middle"), _LOAD, "left")
    centre = F.when(F.col("column_name").isin(texts), F.coalesce(F.expr("try_divide(length, n - n_null)"), F.lit(0.0))).when(F.col("column_name").isin(numbers), F.coalesce("middle", F.lit(0.0)))
    share = lambda c: (F.col(c) / F.col("n")).cast("double")
    return per.select(
        "feed", "load_no", "column_name", "n", share("n_null").alias("nulls"), share("n_bad").alias("bad"), share("n_distinct").alias("distinct"), centre.alias("centre"),
        F.coalesce(F.col("low_x").cast("string"), F.when(~F.col("column_name").isin(numbers), F.col("low_text"))).alias("low"),
        F.coalesce(F.col("high_x").cast("string"), F.when(~F.col("column_name").isin(numbers), F.col("high_text"))).alias("high"),
    )


def mix_shift(counts: DataFrame, column: str, codes: list[str]) -> DataFrame:
    """(feed, load_no, column_name, mix): half the sum over the codes of |share among values of right form - its median over the loads|.

    A load without any value of right form has share 0 of every code.
    """
    mine = counts.where(F.col("column_name") == column)
    shares = mine.groupBy("feed", "load_no").agg(*[F.sum(F.when(F.col("value") == c, F.col("n")).otherwise(0)).alias(f"c{i}") for i, c in enumerate(codes)])
    total = reduce(Col.__add__, [F.col(f"c{i}") for i in range(len(codes))])
    long = shares.withColumn("total", total).select("feed", "load_no", F.posexplode(F.array(*[F.coalesce(F.expr(f"try_divide(c{i}, total)"), F.lit(0.0)) for i in range(len(codes))])).alias("i", "share"))
    mid = long.groupBy("feed", "i").agg(F.expr("percentile(share, 0.5)").alias("mid"))
    return long.join(mid, ["feed", "i"]).groupBy("feed", "load_no").agg((F.sum(F.abs(F.col("share") - F.col("mid"))) / 2).alias("mix")).select("feed", "load_no", F.lit(column).alias("column_name"), "mix")


def departures(profile: DataFrame, mixes: DataFrame | None, limits: Limits = Limits()) -> DataFrame:
    """(feed, load_no, column_name, finding): the loads in which a column departs from its feed's median over the loads."""
    keys = ["feed", "column_name"]
    mids = profile.groupBy(*keys).agg(*[F.expr(f"percentile({c}, 0.5)").alias(f"{c}_mid") for c in ("nulls", "bad", "distinct", "centre")])
    both = profile.join(mids, keys)
    both = both.join(mixes, ["feed", "load_no", "column_name"], "left") if mixes is not None else both.withColumn("mix", F.lit(None).cast("double"))
    off = (F.col("centre") > limits.shift * F.col("centre_mid")) | (F.col("centre") < F.col("centre_mid") / limits.shift) | (F.col("mix") > limits.mix)
    found = F.array(
        F.when(F.abs(F.col("nulls") - F.col("nulls_mid")) > limits.nulls, "nulls"),
        F.when(F.col("bad") - F.col("bad_mid") > limits.pattern, "pattern"),
        F.when(F.col("distinct") < limits.distinct * F.col("distinct_mid"), "distinct"),
        F.when(F.coalesce(off, F.lit(False)), "shift"),
    )
    return both.select("feed", "load_no", "column_name", F.explode(F.array_compact(found)).alias("finding"))


# --- induced expressions -------------------------------------------------------------------------------

#: fixed values: classes of characters as (expression, letter in a shape, bits of one character of the class)
CLASSES = (("[A-Z]", "U", 4.7), ("[a-z]", "L", 4.7), ("[0-9]", "D", 3.33))
#: bits of a character spelled out, of a length, and of a symbol of a shape
LITERAL_BITS, LENGTH_BITS, SHAPE_BITS = 7.0, 5.0, 8.0


def _fixed() -> Col:
    """The fixed shape of column value: a letter of its class for each character of one."""
    plain = "".join(chr(c) for first, last in ("AZ", "az", "09") for c in range(ord(first), ord(last) + 1))
    return F.translate("value", plain, "U" * 26 + "L" * 26 + "D" * 10)


def _levels() -> list[tuple[str, Col, Col]]:
    """(level, shape, data bits) of column value: each level is more general than the one before."""
    v = F.col("value")
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[A-Z]", "U"), "[a-z]", "L"), "[0-9]", "D")
    n = lambda pattern: F.regexp_count(v, F.lit(pattern)).cast("double")
    spelled = reduce(Col.__add__, [n(e) * bits for e, _, bits in CLASSES])
    collapsed = F.regexp_replace(runs, r"([ULD])\1*", "$1+")
    words = F.regexp_replace(F.regexp_replace(collapsed, r"[ULD]\+", "W"), "W+", "W+")
    listed = F.regexp_replace(words, r"^W\+(?:[^W]W\+)*$", "W+(SW+)*")
    n_runs = F.regexp_count(collapsed, F.lit(r"\+")).cast("double")
    seps = F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")).cast("double")
    alnum = n("[A-Za-z0-9]") * 5.95
    return [
        ("constant", v, F.lit(0.0)),
        ("fixed", runs, spelled),
        ("runs", collapsed, spelled + n_runs * LENGTH_BITS),
        ("words", words, alnum + n_runs * LENGTH_BITS),
        ("list", listed, alnum + (n_runs + 1) * LENGTH_BITS + seps * 3.0),
        ("any", F.lit(".*"), F.length(v).cast("double") * LITERAL_BITS),
    ]


def _shaped(values: DataFrame, by: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("lv"), F.lit(name).alias("level"), shape.alias("shape"), bits.alias("bits")) for i, (name, shape, bits) in enumerate(_levels())])
    return values.select(*by, "value", F.inline(cells))


def _expression() -> Col:
    """The regular expression of a shape, to be run on values: true for just the values of that shape at its level."""
    classes = {"U": "[A-Z]", "L": "[a-z]", "D": "[0-9]", "W": "[A-Za-z0-9]"}
    stands = {s: chr(0xE000 + i) for i, s in enumerate(("U+", "L+", "D+", "W+", "U", "L", "D"))}

    def of(symbols: tuple[str, ...]) -> Col:
        # symbols become characters that no value holds, all else is quoted, then they become classes
        c = F.col("shape")
        for s in symbols:
            c = F.replace(c, F.lit(s), F.lit(stands[s]))
        c = F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
        for s in symbols:
            c = F.replace(c, F.lit(stands[s]), F.lit(classes[s[0]] + s[1:]))
        return c

    listed = (F.col("level") == "list") & (F.col("shape") == "W+(SW+)*")
    body = F.when(F.col("level") == "constant", of(())).when(F.col("level") == "fixed", of(("U", "L", "D"))).when(F.col("level") == "runs", of(("U+", "L+", "D+"))).when(listed, "[A-Za-z0-9]+(?:[^A-Za-z0-9][A-Za-z0-9]+)*").when(F.col("level").isin("words", "list"), of(("W+",))).otherwise("(?s).*")
    return F.concat(F.lit(r"\A"), body, F.lit(r"\z"))


def _cost() -> Col:
    """The bits of a shape: its symbols, and for each of its values the choice of the shape and the characters within it."""
    return F.length("shape") * SHAPE_BITS + F.col("bits") + F.col("n_values") * F.log2(F.col("n_all") / F.col("n_values"))


def induce_forms(counts: DataFrame) -> DataFrame:
    """(column_name, level, shape, n_values, expression): the induced expression of each column, one row per shape it consists of; expression can be run on values.

    Over all distinct values of a column each level of generality is priced: its shapes' symbols, and for each
    value the choice of the shape and the characters within it. A shape that costs more than spelling its values
    out is left out, and its values are spelled out. The level of the least total is taken.
    """
    values = counts.where("value is not null").select("column_name", "value").distinct()
    spelled = F.length("value") * LITERAL_BITS + LENGTH_BITS
    shapes = _shaped(values, ["column_name"]).groupBy("column_name", "lv", "level", "shape").agg(F.count(F.lit(1)).alias("n_values"), F.sum("bits").alias("bits"), F.sum(spelled).alias("plain"))
    size = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_all"))
    priced = shapes.join(F.broadcast(size), "column_name").withColumn("cost", _cost()).withColumn("kept", F.col("cost") < F.col("plain"))
    total = priced.groupBy("column_name", "lv").agg(F.sum(F.least("cost", "plain")).alias("total"))
    best = total.groupBy("column_name").agg(F.min(F.struct("total", "lv")).alias("m")).select("column_name", F.col("m.lv").alias("lv"))
    return priced.join(F.broadcast(best), ["column_name", "lv"]).where("kept").select("column_name", "level", "shape", "n_values", _expression().alias("expression"))


def agreed_forms(counts: DataFrame, columns: list[Column]) -> DataFrame:
    """(column_name, fixed, value, level, shape, expression): the parts of each column's induced expression that agrees with its declared form.

    Priced as in induce_forms, with the declared form as label of the distinct values it learns from: a shape that a
    value of wrong form has is left out whatever its price, and the values of right form without a shape are spelled out in
    the expression (level constant). One row per fixed shape that a part covers (value is null) and per value that is spelled out
    (fixed is null). Every level above constant depends on the fixed shape alone, so they are tried once per fixed shape, on a made-up value of it.
    """
    values = counts.where("value is not null").select("column_name", "value").distinct().select("column_name", "value", _fixed().alias("fixed"), _right(columns).alias("right"))
    drawn = values.groupBy("column_name", "fixed").agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("n_right")).withColumn("value", F.translate("fixed", "ULD", "Aa0"))
    cells = Cuts(counts.sparkSession, "shapes").write(_shaped(drawn, ["column_name", "fixed", "n", "n_right"]).where("level <> 'constant'"))[0]
    spelled = F.length("value") * LITERAL_BITS + LENGTH_BITS
    shapes = cells.groupBy("column_name", "lv", "level", "shape").agg(F.sum("n").alias("n_values"), F.sum("n_right").alias("n_right"), F.sum(F.col("bits") * F.col("n")).alias("bits"), F.sum(spelled * F.col("n")).alias("plain"))
    size = cells.where("level = 'any'").groupBy("column_name").agg(F.sum("n").alias("n_all"))
    kept = (F.col("cost") < F.col("plain")) & (F.col("n_right") == F.col("n_values"))
    priced = shapes.join(F.broadcast(size), "column_name").withColumn("cost", _cost()).withColumn("kept", kept)
    total = priced.groupBy("column_name", "lv").agg(F.sum(F.when(F.col("kept"), F.col("cost")).otherwise(F.col("plain"))).alias("total"))
    best = total.groupBy("column_name").agg(F.min(F.struct("total", "lv")).alias("m")).select("column_name", F.col("m.lv").alias("lv"))
    chosen = priced.join(F.broadcast(best), ["column_name", "lv"]).where("kept").select("column_name", "level", "shape")
    covers = cells.join(chosen, ["column_name", "level", "shape"], "left_semi").select("column_name", "fixed", F.lit(None).cast("string").alias("value"), "level", "shape")
    listed = values.where("right").join(covers, ["column_name", "fixed"], "left_anti").select("column_name", F.lit(None).cast("string").alias("fixed"), "value", F.lit("constant").alias("level"), F.col("value").alias("shape"))
    return covers.unionByName(listed).withColumn("expression", _expression())


def conforming(counts: DataFrame, forms: DataFrame) -> DataFrame:
    """counts with fits: whether a part of the column's induced expression (`agreed_forms`) is true for the value; false for null."""
    by_shape = forms.where("fixed is not null").select("column_name", "fixed", F.lit(True).alias("by_shape"))
    by_value = forms.where("value is not null").select("column_name", "value", F.lit(True).alias("by_value"))
    met = counts.withColumn("fixed", _fixed()).join(by_shape, ["column_name", "fixed"], "left").join(by_value, ["column_name", "value"], "left")
    return met.select(*counts.columns, F.coalesce("by_shape", "by_value", F.lit(False)).alias("fits"))


def form_coverage(counts: DataFrame, forms: DataFrame) -> DataFrame:
    """(feed, load_no, column_name, n_conforming, n_nonconforming, coverage, change): rows against the induced expression per load.

    change: difference in coverage to the feed's previous load, null for the first. A column without an expression conforms nowhere.
    """
    values = counts.where("value is not null").groupBy("column_name", "value").agg(F.lit(1).alias("one"))
    chosen = _shaped(values, ["column_name"]).join(forms.select("column_name", "level", "shape"), ["column_name", "level", "shape"], "left_semi").select("column_name", "value", F.lit(1).alias("fits"))
    per = counts.where("value is not null").join(chosen, ["column_name", "value"], "left").groupBy("feed", "load_no", "column_name").agg(
        F.sum(F.when(F.col("fits") == 1, F.col("n")).otherwise(0)).alias("n_conforming"), F.sum(F.when(F.col("fits") == 1, 0).otherwise(F.col("n"))).alias("n_nonconforming"))
    w = Window.partitionBy("feed", "column_name").orderBy("load_no")
    cover = F.col("n_conforming") / (F.col("n_conforming") + F.col("n_nonconforming"))
    return per.withColumn("coverage", cover).withColumn("change", F.col("coverage") - F.lag("coverage").over(w))
