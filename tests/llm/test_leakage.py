from partloom.llm import leakage

from ..conftest import rows

ITEM = "Which Shared planner mirrors the brittle catalogue, although its 12 pallets delay every estimate at level 289?"


def met(spark, docs, items=((1, ITEM),)):
    i = spark.createDataFrame(list(items), "item_id long, passage string")
    return leakage.meetings(i, spark.createDataFrame(list(docs), "doc_id long, text string"))


def test_whole_half_and_less(spark):
    w = ITEM.split()
    docs = [(1, "before " + ITEM.upper() + " after"), (2, " ".join(w[:9])), (3, " ".join(w[:7])), (4, "which  shared—planner mirrors the brìttle cata​logue although its 12 pallets delay"), (5, None), (6, ""), (7, " ".join(w[:4] + ["x"] + w[4:8])), (8, "z " * 50_000 + ITEM)]
    assert {r[1] for r in rows(leakage.leaks(met(spark, docs)))} == {1, 2, 4, 8}


def test_changed_numbers(spark):
    changed = ITEM.replace("12", "77").replace("289", "301")
    m = met(spark, [(1, changed), (2, ITEM)])
    got = {r["doc_id"]: r for r in m.collect()}
    assert got[1]["n_template"] == got[1]["n_words"] == 17 and got[1]["n_changed"] == 2 and got[1]["consistent"] and got[1]["n_verbatim"] < 17
    assert got[2]["n_verbatim"] == 17 and got[2]["n_changed"] == 0
    double = "the lot of 12 parts and the lot of 12 parts and the end"
    m = met(spark, [(1, "the lot of 5 parts and the lot of 6 parts and the end"), (2, "the lot of 5 parts and the lot of 5 parts and the end")], [(1, double)])
    assert {r["doc_id"]: r["consistent"] for r in m.collect()} != {1: True, 2: True}
    assert rows(leakage.reworked(met(spark, [(1, "alpha 7 beta 8 gamma 9 delta 4 eps")], [(3, "alpha 1 beta 2 gamma 3 delta 6 eps")])), "item_id", "doc_id") == [(3, 1)]


def test_edges(spark):
    assert met(spark, []).count() == 0
    assert met(spark, [(1, ITEM)], [(1, None), (2, ""), (3, "four words are few")]).count() == 0
    assert leakage.leaks(met(spark, [(1, ITEM), (1, ITEM)], [(1, ITEM), (1, ITEM)])).count() == 1


def test_passages_beyond_one_block(spark):
    """More passage words than a block holds: the same rows from several scans."""
    items = [(i, f"the clerk number {i} files {i + 3} forms in the archive of hall {i % 5} at noon") for i in range(30)]
    docs = [(i, f"{x} {items[(i + 7) % 30][1]}") for i, x in items]
    i, d = spark.createDataFrame(items, "item_id long, passage string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = rows(leakage.meetings(i, d).drop("places"))
    assert want == rows(leakage.meetings(i, d, block_words=40).drop("places")) and len(want) >= 60


def test_names_are_learned_where_capitals_tell():
    en = [("We met Petra in Oslo. Then Petra left the hall.", "en"), ("The hall of Oslo is THE hall", None)]
    assert leakage.learned_names(en) == {"petra", "oslo"}
    assert leakage.learned_names([("Wir sahen Haus und Hof", "de")]) == frozenset()
    assert leakage.learned_names([("the hall is at Hall street", "en"), ("THE END", "en")]) == frozenset()


def test_reworked_items_are_found(spark):
    """Planted passages with other numbers, units and names: at least nine tenths are found, and nothing that isn't planted."""
    import random

    rnd = random.Random(4)
    people, towns = ("Petra", "Iwan", "Laila", "Tomas", "Berit"), ("Oslo", "Gdansk", "Faro", "Turku", "Bari")
    others, elsewhere = ("Quentin", "Zelda", "Ulrike", "Xaver"), ("Lund", "Vigo", "Riga", "Pula")
    word = lambda: "".join(rnd.choice(("ka", "lo", "mi", "tru", "sen", "vo", "par", "del")) for _ in range(3))
    items, docs, planted = [], [], set()
    for i in range(40):
        w = [word() for _ in range(14)]
        make = lambda p, q, r, low: f"On {w[0]} {low + rnd.randrange(9)} the {w[1]} {p} {w[2]} {w[3]} {10 * low + rnd.randrange(9)} {w[4]} {w[5]} in {q} {w[6]} {w[7]} {low + 20 + rnd.randrange(9)} kg {w[8]} {w[9]} for {r} {w[10]} {w[11]} {w[12]} {w[13]}."  # noqa: E731, B023
        items.append((i, make(rnd.choice(people), *rnd.sample(towns, 2), 10)))
        docs.append((i, "some words come first. " + make(rnd.choice(others), *rnd.sample(elsewhere, 2), 50) + " and some follow"))
        planted.add((i, i))
    things = ("crates", "drums", "rolls")
    docs += [(100 + i, f"a plain note about {rnd.choice(things)} and day {i} of the week in the hall") for i in range(40)]
    m = met(spark, docs, items)
    assert leakage.leaks(m).count() == 0
    got = set(rows(leakage.reworked(m), "item_id", "doc_id"))
    assert len(got & planted) >= 36 and len(got - planted) <= 4


def test_each_place_of_a_changed_passage_counts(spark):
    text = "which {} pallets delay {} brittle orders at level {} before {} planners mirror the {} lots"
    item, one, two = (text.format(*(n + k for n in (12, 14, 289, 3, 8))) for k in (0, 20, 40))
    more = lambda x: x.replace(" orders ", " orders again ").replace(" before ", " before all ")
    docs = [(1, f"{one} and then {two}"), (2, f"{one} and then orders at level 5 before"), (3, f"{item} and then {two}"), (4, one), (5, item), (6, f"{more(one)} and then {more(two)}"), (7, "orders at level 5 before and orders at level 6 before")]
    m = met(spark, docs, [(1, item)])
    assert rows(leakage.reworked(m), "doc_id", "n_changed") == [(1, 5), (2, 5), (3, 5), (4, 5), (6, 4)]
    assert {r["doc_id"] for r in leakage.leaks(m).collect()} == {3, 5}
