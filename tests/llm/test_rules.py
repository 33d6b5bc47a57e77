import duckdb

from pagemill.llm import rules

from .cases import empty, odd, row


def both(spark, docs):
    got = rules.digests(docs)
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(rules.ORACLE).fetch_df()
    key = lambda rows: sorted(tuple("" if x is None or x != x else str(int(x)) if not isinstance(x, str) else x for x in r) for r in rows)
    return key(tuple(r[c] for c in columns) for r in got.collect()), key(want[columns].astype(object).where(want[columns].notna(), None).itertuples(index=False))


def test_odd_rows_as_sql(spark):
    a, b = both(spark, odd(spark))
    assert a == b
    assert rules.digests(empty(spark)).collect() == []


def test_shared_lines(spark):
    line = "This line stands on every page of the host and says nothing of its own at all, year after year."
    rows = [row(i, f"{line}\nown words of page {chr(97 + i)} " + " ".join(f"w{i}x{k}" for k in range(60))) for i in range(25)]
    rows += [row(100 + i, f"{line}\n{line.upper()} 12\n short") for i in range(25)]
    rows += [row(200 + i, f"{line}\n" + " ".join(f"v{i}x{k}" for k in range(30)), source="other") for i in range(20)]
    docs = spark.createDataFrame(rows, odd(spark).schema)
    a, b = both(spark, docs)
    assert a == b
    kept = {r.doc_id: r.kept for r in rules.judge(docs).collect()}
    assert all(kept[i] for i in range(25)) and not any(kept[100 + i] for i in range(25)) and all(kept[200 + i] for i in range(20))
    texts = {r.doc_id: r.text for r in rules.cleaned(docs).collect()}
    assert texts[0].startswith("own words") and texts[200].startswith("This line")


def test_repeated_windows_by_hand(spark):
    words = [f"w{i}" for i in range(30)]
    text = " ".join(words[:10] + words[20:30] + words[:10] + ["z"] * 9)
    got = rules.judge(spark.createDataFrame([row(1, text)], odd(spark).schema)).first()
    grams = [tuple(text.split()[i : i + 8]) for i in range(len(text.split()) - 7)]
    covered = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 8)}
    assert got.n_repeat_words == len(covered)


def test_no_python_in_the_plan(spark, sf):
    plan = rules.digests(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
