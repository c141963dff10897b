"""Every registered query against its SQL in another engine, and the learners by rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(request):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    yield con
    con.close()


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return "nan" if math.isnan(value) else repr(round(float(value), 6) + 0.0)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    found = table(df.columns, df.collect())
    cursor = duck.execute(ORACLE[name])
    wanted = table([d[0] for d in cursor.description], cursor.fetchall())
    assert found == wanted
    assert found[1]


LEARNED = [n for n in sorted(QUERIES) if n not in ORACLE]


@pytest.mark.parametrize("name", LEARNED)
def test_learned(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert rows
    for column in ("yhat", "ground_truth", "pseudo_label", "sentiment"):
        if column in rows[0]:
            assert all(r[column] in (0, 1, 2) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_learners_beat_the_majority_class(spark):
    """On well separated classes every learner must do better than guessing."""
    import numpy as np

    from opinweave.operators import learners as ln

    rng = np.random.default_rng(0)
    rows = []
    for i in range(360):
        y = i % 3
        x = rng.normal(scale=0.6, size=4)
        x[y] += 3.0
        rows.append((i, y, [float(v) for v in x]))
    df = spark.createDataFrame(rows, "id INT, y INT, features ARRAY<DOUBLE>").persist()
    train, test = df.where("id < 240"), df.where("id >= 240")
    quick = {"Random Forest": {"n_trees": 10, "depth": 5}, "Gradient Boosting": {"rounds": 3, "depth": 3},
             "AdaBoost": {"rounds": 25, "rate": 0.5}, "SVM": {"max_iter": 20}}
    for name, learner in ln.LEARNERS.items():
        scored = ln.fit_and_predict(train, test, learner, **quick.get(name, {})).collect()
        right = sum(r["y"] == r["yhat"] for r in scored) / len(scored)
        assert right > 0.6, (name, right)
