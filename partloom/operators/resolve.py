"""Duplicate parts by blocking, named similarity features, weighted or learned scores, and their evaluation."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from partloom.session import Cuts

#: fixed values: abbreviations, weights of the features, limits of the bands
ABBREVIATIONS = {"SS": "STAINLESS", "ALUM": "ALUMINUM", "MFG": "MANUFACTURING", "INCORPORATED": "INC", "CORPORATION": "CORP"}
WEIGHTS = {
    "part_number_exact": 0.22, "part_number_normalized_match": 0.20, "part_number_char_similarity": 0.14, "description_token_jaccard": 0.12, "description_char_similarity": 0.08,
    "mpn_match": 0.12, "uom_compatible": 0.02, "category_match": 0.04, "cost_proximity": 0.05, "source_system_differs": 0.0, "lead_time_proximity": 0.01,
}
RECOMMEND, REVIEW = 0.72, 0.55
#: blocks of more records say too little to compare within
LARGEST_BLOCK = 200
#: columns of prepared() that pairs are compared on
COMPARED = ("pn", "pn_norm", "mpn", "text", "uom", "category", "cost", "lead", "source", "tokens")
CHAR_FEATURES = ("part_number_char_similarity", "description_char_similarity")


def norm_text(c: str) -> Column:
    """Upper case, single spaces, abbreviations written out; '' for null."""
    words = F.split(F.trim(F.regexp_replace(F.upper(F.coalesce(F.col(c), F.lit(""))), r"\s+", " ")), " ")
    full = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(full, w), w)), " ")


def tokens(text: Column) -> Column:
    """The distinct words of a normalised text, - standing between words."""
    return F.array_distinct(F.filter(F.split(F.translate(text, "-", " "), " "), lambda w: w != ""))


def _alnum(c: str) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(F.col(c), F.lit(""))), "[^A-Z0-9]", "")


def prepared(parts: DataFrame) -> DataFrame:
    """What pairs are compared on, one row per part; missing texts are ''."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = parts.select("part_key", empty("source_part_number").alias("pn"), _alnum("source_part_number").alias("pn_norm"), _alnum("manufacturer_part_number").alias("mpn"), norm_text("description").alias("text"), empty("uom").alias("uom"), empty("category").alias("category"), F.col("standard_cost").cast("double").alias("cost"), F.col("lead_time_days").cast("double").alias("lead"), empty("source_system").alias("source"))
    return d.withColumn("tokens", tokens(F.col("text")))


def _blocks() -> Column:
    """The blocks of a part: start of the part number, maker number, category with the first word of the description."""
    pn, first = _alnum("pn"), F.array_min(tokens(F.col("text")))
    keys = [F.when(F.length(pn) >= 6, F.concat(F.lit("n:"), F.substring(pn, 1, 6))), F.when(F.col("mpn") != "", F.concat(F.lit("m:"), "mpn")), F.when(first.isNotNull() & (F.col("category") != ""), F.concat(F.lit("c:"), "category", F.lit("|"), first))]
    return F.array_compact(F.array(*keys))


def block_keys(p: DataFrame) -> DataFrame:
    """(block, part_key): every part in each of its blocks."""
    return p.select("part_key", F.explode(_blocks()).alias("block"))


def candidate_pairs(p: DataFrame, largest: int = LARGEST_BLOCK) -> DataFrame:
    """(a, b), a < b: pairs that share a block of 2 to `largest` parts, each once. Block sizes are counted before anything is joined."""
    k = block_keys(p)
    ok = k.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, largest)).select("block")
    kept = k.join(ok, "block", "left_semi")
    return kept.select("block", F.col("part_key").alias("a")).join(kept.select("block", F.col("part_key").alias("b")), "block").where("a < b").select("a", "b").distinct()


def _near(a: str, b: str) -> Column:
    hi, lo = F.greatest(F.abs(F.col(a)), F.abs(F.col(b))), F.least(F.abs(F.col(a)), F.abs(F.col(b)))
    return F.when(F.col(a).isNull() | F.col(b).isNull(), 0.0).when(hi == 0, 1.0).otherwise(lo / hi)


def features(pairs: DataFrame, p: DataFrame) -> DataFrame:
    """pairs with all features but the two character similarities, whose texts go along (pn_a, pn_b, text_a, text_b)."""
    side = lambda s: p.select(F.col("part_key").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in COMPARED])
    return compared(pairs.join(side("a"), "a").join(side("b"), "b"))


def compared(x: DataFrame) -> DataFrame:
    """features() of pairs that carry the columns COMPARED of either part. They come out of a generator, so that no filter on them computes them again."""
    same = lambda c: ((F.col(f"{c}_a") == F.col(f"{c}_b")) & (F.col(f"{c}_a") != "")).cast("double")
    common, every = F.size(F.array_intersect("tokens_a", "tokens_b")), F.size(F.array_union("tokens_a", "tokens_b"))
    uom = ((F.col("uom_a") == F.col("uom_b")) | (F.col("uom_a") == "") | (F.col("uom_b") == "")).cast("double")
    cells = F.struct(
        same("pn").alias("part_number_exact"), same("pn_norm").alias("part_number_normalized_match"), F.when((F.size("tokens_a") > 0) & (F.size("tokens_b") > 0), common / every).otherwise(0.0).alias("description_token_jaccard"), same("mpn").alias("mpn_match"),
        uom.alias("uom_compatible"), (F.col("category_a") == F.col("category_b")).cast("double").alias("category_match"), _near("cost_a", "cost_b").alias("cost_proximity"), (F.col("source_a") != F.col("source_b")).cast("double").alias("source_system_differs"), _near("lead_a", "lead_b").alias("lead_time_proximity"))
    return x.select("a", "b", F.inline(F.array(cells)), F.col("pn_norm_a").alias("pn_a"), F.col("pn_norm_b").alias("pn_b"), "text_a", "text_b")


def met(p: DataFrame, largest: int = LARGEST_BLOCK) -> DataFrame:
    """features() of the pairs of candidate_pairs(), straight from the blocks: a pair comes once for every block it shares.

    Parts go to their blocks with all that is compared, in one shuffle; the many pairs are never written, only what is kept of them later.
    """
    ok = block_keys(p).groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, largest)).select("block")
    plain = [c for c in COMPARED if c not in ("pn_norm", "tokens")]
    inside = p.select("part_key", *plain, F.explode(_blocks()).alias("block")).join(ok.hint("merge"), "block", "left_semi")
    # what follows from other columns is made after the shuffle
    full = inside.withColumns({"pn_norm": _alnum("pn"), "tokens": tokens(F.col("text"))})
    side = lambda s: full.select("block", F.col("part_key").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in COMPARED])
    return compared(side("a").join(side("b").hint("merge"), "block").where("a < b"))


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(DoubleType())
def char_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, 0 if a text is empty; equal pairs of a batch are computed once."""
    known: dict[tuple[str, str], float] = {}
    return pd.Series([known[k] if (k := (x, y)) in known else known.setdefault(k, _ratio(x, y)) for x, y in zip(a, b)])


def scored(feats: DataFrame, least: float = REVIEW) -> DataFrame:
    """Pairs of at least the given score with all features, score (rounded to 4) and band, which is set before rounding.

    Character similarities are costly; a pair that couldn't reach `least` with the most they can be is left out before them. The
    characters two texts share stand in the same order in both, so the similarity is at most 1 - edit distance / length of both.
    """
    number, text = (WEIGHTS[k] for k in CHAR_FEATURES)
    bound = lambda x: 1 - F.coalesce(F.try_divide(F.levenshtein(F.col(f"{x}_a"), F.col(f"{x}_b")), F.length(f"{x}_a") + F.length(f"{x}_b")), F.lit(1.0))
    c, enough = F.col("cheap"), F.lit(least - 1e-9)
    cheap = reduce(Column.__add__, [F.col(k) * w for k, w in WEIGHTS.items() if k not in CHAR_FEATURES and w])
    some = feats.withColumn("cheap", cheap).where(c + number + text >= enough).where(c + number * bound("pn") + text >= enough).where(c + number * bound("pn") + text * bound("text") >= enough)
    read = some.withColumn("part_number_char_similarity", char_similarity("pn_a", "pn_b")).where(c + number * F.col("part_number_char_similarity") + text * bound("text") >= enough)
    full = read.withColumn("description_char_similarity", char_similarity("text_a", "text_b"))
    s = F.col("cheap") + F.col("part_number_char_similarity") * WEIGHTS["part_number_char_similarity"] + F.col("description_char_similarity") * WEIGHTS["description_char_similarity"]
    band = F.when(s >= RECOMMEND, "high_confidence_recommendation").when(s >= REVIEW, "human_review_required").otherwise("unresolved")
    return full.withColumn("raw", s).where(F.col("raw") >= least).select("a", "b", F.round("raw", 4).alias("score"), band.alias("band"), *WEIGHTS)


def evidence(matches: DataFrame) -> DataFrame:
    """(a, b, reasons): the features that weigh more than 0.01, the strongest first."""
    cells = F.array(*[F.struct((F.lit(-w) * F.col(k)).alias("w"), F.lit(k).alias("k"), F.round(k, 2).cast("decimal(4,2)").cast("string").alias("v")) for k, w in WEIGHTS.items()])
    strong = F.filter(F.sort_array(cells), lambda x: x["w"] < -0.01)
    return matches.select("a", "b", F.transform(strong, lambda x: F.concat(x["k"], F.lit("="), x["v"])).alias("reasons"))


def find_matches(parts: DataFrame, least: float = REVIEW) -> DataFrame:
    """Blocking, features, scores: the pairs of at least the given score."""
    p = prepared(parts)
    return scored(features(candidate_pairs(p), p), least)


def matches_within_blocks(p: DataFrame, least: float) -> DataFrame:
    """find_matches() of prepared parts by met(): the few pairs that score enough are made distinct, not all candidates."""
    return scored(met(p), least).dropDuplicates(["a", "b"])


def evaluation(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(difficulty, predicted, labelled, true_positives, precision, recall, f1): overall in difficulty 'all', and recall per difficulty.

    found: (a, b); truth: (a, b, difficulty), both with a < b. Precision is null where nothing was predicted for a difficulty alone.
    """
    both = found.select("a", "b", F.lit(1).alias("p")).distinct().join(truth.select("a", "b", "difficulty").distinct(), ["a", "b"], "full_outer")
    sets = both.select(F.explode(F.array_compact(F.array(F.lit("all"), F.col("difficulty")))).alias("difficulty"), "p", F.col("difficulty").isNotNull().alias("t"))
    n = sets.groupBy("difficulty").agg(F.count(F.when(F.col("p") == 1, 1)).alias("predicted"), F.count(F.when(F.col("t"), 1)).alias("labelled"), F.count(F.when((F.col("p") == 1) & F.col("t"), 1)).alias("true_positives"))
    whole = F.col("difficulty") == "all"
    precision, recall = F.when(whole, F.coalesce(F.try_divide("true_positives", "predicted"), F.lit(0.0))), F.coalesce(F.try_divide("true_positives", "labelled"), F.lit(0.0))
    f1 = F.when(whole, F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)))
    return n.select("difficulty", F.when(whole, F.col("predicted")).alias("predicted"), "labelled", "true_positives", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def evaluation_by_maker(found: DataFrame, p: DataFrame, shortest: int = 8) -> DataFrame:
    """evaluation() for each band, the labelled duplicates being the pairs of one maker number in different sources.

    found: (a, b, band), a < b; p as given by prepared(). The band human_review_required counts the recommended pairs too.
    Pairs are easy if their units agree, else hard. Labelled pairs are counted, not built, so large groups count in full.
    """
    n, half = F.col("n"), lambda total, same: ((total * total - same) / 2).cast("long")
    cells = p.where(F.length("mpn") >= shortest).groupBy("mpn", "source", "uom").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda *by: (lambda c: c.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(n * n).alias("q")).agg(F.coalesce(F.sum(half(F.col("t"), F.col("q"))), F.lit(0)).alias("labelled")))(cells.groupBy("source", *by).agg(F.sum("n").alias("n")))
    both = pairs("mpn").withColumnRenamed("labelled", "every").crossJoin(pairs("mpn", "uom").withColumnRenamed("labelled", "same_unit"))
    labelled = both.select(F.inline(F.array(*[F.struct(F.lit(d).alias("difficulty"), c.alias("labelled")) for d, c in (("all", F.col("every")), ("easy", F.col("same_unit")), ("hard", F.col("every") - F.col("same_unit")))])))
    bands = ["high_confidence_recommendation", "human_review_required"]
    labelled = labelled.where("difficulty = 'all' or labelled > 0").withColumn("band", F.explode(F.array(*[F.lit(b) for b in bands])))
    side = lambda k: p.select(F.col("part_key").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("mpn", "source", "uom")])
    kind = F.when((F.length("mpn_a") >= shortest) & (F.col("mpn_a") == F.col("mpn_b")) & (F.col("source_a") != F.col("source_b")), F.when(F.col("uom_a") == F.col("uom_b"), "easy").otherwise("hard"))
    told = found.join(side("a"), "a").join(side("b"), "b").select("band", kind.alias("kind"))
    told = told.where(F.col("band").isin(bands)).select(F.explode(F.when(F.col("band") == bands[0], F.array(*[F.lit(b) for b in bands])).otherwise(F.array("band"))).alias("band"), "kind")
    hits = told.select("band", "kind", F.explode(F.array_compact(F.array(F.lit("all"), "kind"))).alias("difficulty")).groupBy("band", "difficulty").agg(F.count(F.lit(1)).alias("predicted"), F.count("kind").alias("true_positives"))
    whole = F.col("difficulty") == "all"
    out = labelled.join(hits, ["band", "difficulty"], "left").na.fill(0, ["predicted", "true_positives"])
    precision, recall = F.when(whole, F.coalesce(F.try_divide("true_positives", "predicted"), F.lit(0.0))), F.coalesce(F.try_divide("true_positives", "labelled"), F.lit(0.0))
    f1 = F.when(whole, F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)))
    return out.select("band", "difficulty", F.when(whole, F.col("predicted")).alias("predicted"), "labelled", "true_positives", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def candidate_recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (labelled, as_candidates, recall): how many of the labelled pairs (a, b) the blocking proposes; recall 0 without labels."""
    both = truth.select("a", "b").distinct().join(candidates.select("a", "b", F.lit(1).alias("hit")).distinct(), ["a", "b"], "left")
    return both.agg(F.count(F.lit(1)).alias("labelled"), F.count("hit").alias("as_candidates")).withColumn("recall", F.round(F.coalesce(F.try_divide("as_candidates", "labelled"), F.lit(0.0)), 4))


def recall_by_difficulty(judged: DataFrame, truth: DataFrame) -> DataFrame:
    """(difficulty, labelled, found, recall) of the labelled pairs among judged (a, b, hit)."""
    mine = judged.select("a", "b", "hit").join(truth.select("a", "b", "difficulty").distinct(), ["a", "b"])
    return mine.groupBy("difficulty").agg(F.count(F.lit(1)).alias("labelled"), F.count(F.when(F.col("hit"), 1)).alias("found")).withColumn("recall", F.round(F.col("found") / F.col("labelled"), 4))


def save_model(fitted, cut: float, folder: str) -> None:
    """A fitted model with its threshold and features, into a folder that must not hold one yet."""
    fitted.save(f"{folder}/model")
    from pyspark.sql import SparkSession

    SparkSession.active().createDataFrame([(type(fitted).__name__, cut, list(WEIGHTS))], "model string, threshold double, features array<string>").write.json(f"{folder}/about")


def load_model(spark: SparkSession, folder: str):
    """(fitted model, threshold, features) as saved by save_model."""
    from pyspark.ml import classification

    about = spark.read.schema("model string, threshold double, features array<string>").json(f"{folder}/about").first()
    return getattr(classification, about["model"]).load(f"{folder}/model"), about["threshold"], list(about["features"])


def pair_groups(pairs: DataFrame) -> DataFrame:
    """pairs with group: the number, from 0, of the connected group their parts belong to, by its smallest part."""
    from partloom.operators.stars import weak_groups

    g = weak_groups(pairs.select(F.col("a").alias("parent"), F.col("b").alias("child")))
    return pairs.join(g.select(F.col("part").alias("a"), "group_key"), "a")


def split(pairs: DataFrame, seed: int = 7) -> DataFrame:
    """pairs with part: train, validation or test (6 : 2 : 2 of the groups), so that no entity is in two of them."""
    h = F.pmod(F.xxhash64(F.lit(seed), "group_key"), F.lit(10))
    return pairs.withColumn("part", F.when(h < 6, "train").when(h < 8, "validation").otherwise("test"))


def shared_entities(split_pairs: DataFrame) -> DataFrame:
    """Parts that occur in more than one part of a split; none if it is sound."""
    ends = split_pairs.select("part", F.explode(F.array("a", "b")).alias("part_key")).distinct()
    return ends.groupBy("part_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def threshold(scores: DataFrame, least_precision: float = 0.95) -> float:
    """The score from which F1 is best while precision holds, else the one of greatest precision; scores: (score, label).

    Counts per distinct score (rounded to 4) are summed from the top, so the driver gets at most 10,001 rows.
    """
    n = scores.groupBy(F.round("score", 4).alias("score")).agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("score")).collect()
    total, tp, k = sum(r["pos"] for r in n), 0, 0
    best = (False, -1.0, 0.0)
    for r in n:
        tp, k = tp + r["pos"], k + r["n"]
        p, rec = tp / k, tp / total if total else 0.0
        f1 = 2 * p * rec / (p + rec) if p + rec else 0.0
        best = max(best, (p >= least_precision, f1 if p >= least_precision else p, -r["score"]))
    return -best[2]


def train(data: DataFrame, model: str = "logistic", seed: int = 7):
    """(fitted model, threshold, metrics as one row) on pairs with all features, `label` and the split in `part`.

    Rows of the rarer label weigh more in the logistic model. The threshold is chosen on the validation part, metrics are of the test part.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    spark = data.sparkSession
    written, _, path = Cuts(spark, "train").write(data.select("a", "b", "part", F.col("label").cast("double").alias("label"), *WEIGHTS))
    # a fitted model's functions hold their session, and one that has observed counts can't be sent to tasks
    d = spark.newSession().read.schema(written.schema).parquet(path)
    c = d.where("part = 'train'").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos, all_ = float(c["pos"] or 0), float(c["n"])
    if not 0 < pos < all_:
        raise ValueError("the training part needs pairs of both labels")
    weighed = d.withColumn("weight", F.when(F.col("label") == 1, all_ / (2 * pos)).otherwise(all_ / (2 * (all_ - pos))))
    learner = LogisticRegression(weightCol="weight", maxIter=200) if model == "logistic" else GBTClassifier(maxIter=20, maxDepth=3, seed=seed)
    weighed = weighed.withColumn("features", array_to_vector(F.array(*WEIGHTS)))
    fitted = learner.fit(weighed.where("part = 'train'"))
    out = fitted.transform(weighed).select("a", "b", "part", "label", vector_to_array("probability")[1].alias("score"))
    cut = threshold(out.where("part = 'validation'").select("score", F.col("label").cast("long").alias("label")))
    t = out.where("part = 'test'").withColumn("hit", F.round("score", 4) >= cut)
    n_if = lambda e: F.count(F.when(F.expr(e), 1))
    m = t.agg(n_if("hit and label = 1").alias("tp"), n_if("hit and label = 0").alias("fp"), n_if("not hit and label = 1").alias("fn"), n_if("not hit and label = 0").alias("tn"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    f = {k: F.col(k) for k in ("tp", "fp", "fn", "tn")}
    metrics = m.select(F.lit(model).alias("model"), F.lit(cut).alias("threshold"), "tp", "fp", "fn", "tn", rate(f["tp"], f["tp"] + f["fp"]).alias("precision"), rate(f["tp"], f["tp"] + f["fn"]).alias("recall"), rate(2 * f["tp"], 2 * f["tp"] + f["fp"] + f["fn"]).alias("f1"), rate(f["fp"], f["fp"] + f["tn"]).alias("false_positive_rate"), rate(f["fn"], f["fn"] + f["tp"]).alias("false_negative_rate"))
    return fitted, cut, spark.createDataFrame(metrics.collect(), metrics.schema)


def dispersion(metrics: DataFrame, by: str = "model") -> DataFrame:
    """Mean, sample deviation, least and greatest of the metrics of several runs."""
    return metrics.groupBy(by).agg(*[f(c).alias(f"{c}_{n}") for c in ("precision", "recall", "f1") for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])


