import re

from turnstone.llm.decontaminate import contamination, without_contaminated


def words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def runs(w, size):
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(docs, items):
    out = set()
    for doc_id, text in docs:
        for item_id, item in items:
            w = words(item)
            size = min(5, len(w))
            want = runs(w, size) if size else set()
            have = len(want & runs(words(text), size)) if size else 0
            if want and have >= 0.8 * len(want) - 1e-9:
                out.add((doc_id, item_id, len(want), have))
    return out


def test_as_brute_force(spark, corpus, prose, frame):
    docs = [d for d in corpus]
    long = prose.text(40)
    edited = long.split(" ")
    edited[1] = "other"
    items = [(1, long), (2, docs[3][1]), (3, None), (4, ""), (5, "only three words"), (6, "one"), (None, prose.text(20)), (1, long), (7, "é ü ß ñ a b")]
    docs += [(200, prose.text(300) + " " + long.upper() + " " + prose.text(300)), (201, " ".join(edited)), (202, "x only, THREE words!"), (203, "a ONE b"),
             (204, " ".join(long.split(" ")[:20])), (205, items[6][1]), (206, "É-ü_ß ñ\na b")]
    got = contamination(frame(docs), spark.createDataFrame([(*i, "q") for i in items], "item_id long, text string, n int".replace("n int", "n string")))
    assert {tuple(r)[:4] for r in got.collect()} == brute(docs, items)
    kept = without_contaminated(frame(docs), spark.createDataFrame(items, "item_id long, text string"))
    bad = {(i, t) for i, t in docs if any(b[0] == i for b in brute([(i, t)], items))}
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str(d) for d in docs if d not in bad)


def test_empty_tables(spark, corpus, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(corpus)
    assert contamination(docs, none).count() == 0
    assert without_contaminated(docs, none).count() == len(corpus)
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contamination(docs.limit(0), some).count() == 0


def test_no_python_in_the_plan(spark, corpus, frame):
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    plan = contamination(frame(corpus), some)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("InPython", "EvalPython", "Arrow", "Pandas"))
