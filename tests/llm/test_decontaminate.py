import itertools
import random

import duckdb
import pandas as pd

from tricorpus.llm import decontaminate


def test_masks_hit_every_window_with_few_replaced_words():
    for window, replaced in ((13, 2), (16, 3), (20, 4)):
        for gone in itertools.combinations(range(window), replaced):
            ok = any(all(c == "0" or s + i not in gone for i, c in enumerate(m)) for m in decontaminate.MASKS for s in range(window - len(m) + 1))
            assert ok, (window, gone)


def test_masks_find_every_item_with_every_allowed_pattern():
    for n in range(1, 21):
        w = min(n, 16)
        replaced = w - -(-4 * w // 5)
        masks = decontaminate.masks_for(n)
        for gone in itertools.combinations(range(w), replaced):
            assert any(all(c == "0" or s + i not in gone for i, c in enumerate(m)) for m in masks for s in range(w - len(m) + 1)), (n, gone)


def test_items_of_all_lengths_equal_sql_without_seeds(spark):
    """Every allowed pattern of replaced words for items of 1 to 11 words, many null ids and one id with many texts."""
    r = random.Random(19)
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in [*range(1, 12), 15, 16, 30]]
    texts = [" ".join(f"t{r.randrange(50)}" for _ in range(12)) for _ in range(10)]
    for n, item in items[:11]:
        w = item.split()
        texts += [" ".join(["before"] + ["gone" if k in gone else x for k, x in enumerate(w)] + ["after"]) for m in range(3) for gone in itertools.combinations(range(n), m)]
    for _, item in items[11:]:
        for _ in range(25):
            w = item.split()
            for k in r.sample(range(len(w)), r.randint(0, len(w) // 4)):
                w[k] = "gone"
            texts.append(" ".join(w[r.randint(0, 3) :]))
    docs = [(k, t) for k, t in enumerate(texts)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(d, b, least=1)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    rel = con.execute(decontaminate.ORACLE_ALL)
    names = [c[0] for c in rel.description]
    want = {tuple(dict(zip(names, x))[c] for c in got.columns) for x in rel.fetchall()}
    assert set(map(tuple, got.collect())) == want and {i for _, i, *_ in want} == {i for i, _ in items}
    bad = {i for i, *_ in want}
    for ids in (lambda k: None, lambda k: 7):  # rows are judged by their own texts, whatever their ids
        kept = decontaminate.drop_contaminated(spark.createDataFrame([(ids(k), t) for k, t in docs], "doc_id long, text string"), b)
        assert sorted(x.text for x in kept.collect()) == sorted(t for k, t in docs if k not in bad)


def tables(spark):
    r = random.Random(9)
    word = lambda: f"t{r.randrange(2000)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([30, 20, 12, 8, 7, 40, 16])] + [(50, None), (51, ""), (0, None)]
    docs = [(i, " ".join(word() for _ in range(60))) for i in range(20)]
    for k in range(7):
        w = items[k][1].split()
        docs.append((100 + k, " ".join([word() for _ in range(5)] + w + [word() for _ in range(5)])))
        changed = list(w)
        for j in range(0, len(w), 6):
            changed[j] = "other"
        docs.append((200 + k, ", ".join(changed).upper()))
        docs.append((300 + k, " ".join(w[: len(w) // 2])))
    docs += [(400, None), (401, ""), (402, items[0][1]), (402, items[0][1])]
    return docs, items, spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, start int")


def test_equals_sql_and_finds_what_was_planted(spark):
    docs, items, d, b = tables(spark)
    got = decontaminate.contaminated(d, b)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(sorted(set(docs), key=str), columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    rel = con.execute(decontaminate.ORACLE)
    names = [c[0] for c in rel.description]
    want = [tuple(dict(zip(names, x))[c] for c in got.columns) for x in rel.fetchall()]
    assert sorted(set(map(tuple, got.collect()))) == sorted(set(want))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert found >= {(100 + k, k) for k in (0, 1, 2, 3, 5, 6)} | {(200 + k, k) for k in (0, 1, 5, 6)}
    assert not any(i < 100 for i, _ in found)
    assert not any(k == 4 for _, k in found)  # too short to be searched


def test_plan_has_no_python(spark):
    _, _, d, b = tables(spark)
    plan = decontaminate.contaminated(d, b)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_dropping_keeps_columns_and_null_ids(spark):
    _, items, _, b = tables(spark)
    d = spark.createDataFrame([(1, items[0][1], 7), (2, "clean text", 8), (None, "clean too", 9), (3, None, 1)], "doc_id long, text string, item_id int")
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.schema == d.schema and {r.doc_id for r in kept.collect()} == {2, None, 3}
    assert decontaminate.contaminated(d.where("false"), b).count() == 0
    assert decontaminate.contaminated(d, b.where("false")).count() == 0
