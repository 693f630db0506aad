import random

import pytest
from pyspark.sql import functions as F

WORDS = ["".join(random.Random(i).choices(["ka", "lo", "mi", "ter", "von", "sa", "ri", "be"], k=3)) for i in range(400)]
DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use inside or return
CLASHES = ["score", "kept", "ids", "key", "n", "spans", "severity", "toxic", "size", "shard", "row", "bands", "id", "blob", "start", "h1", "d0", "d1", "__spans", "__kept", "__row", "windows", "at", "salt"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choices(WORDS, k=n)) + "."


def build(spark, path, docs, labels, vectors):
    d = spark.createDataFrame(docs, DDL)
    for c in CLASHES:
        d = d.withColumn(c, F.lit("x"))
    d.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def edge_docs():
    base = [prose(i, 60) for i in range(40)]
    docs = [(i, t, "en", "a", len(t)) for i, t in enumerate(base)]
    docs += [(100 + i, base[0], "en", "hot", 1) for i in range(30)]  # a third of all: one text
    docs += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \n\t ", "de", "a", 4), (203, "one", None, "b", 3)]
    docs += [(204, prose(7, 20_000), "en", "long", 1), (205, "é日本🎉 ▁ \x00 '\"", "xx", "b", 9), (206, "AAAA" * 500, "en", "b", 2000)]
    docs += [(0, base[0], "en", "a", 1), (None, base[3], "en", "a", 1), (None, "no id here at all", "en", "a", 1)]
    docs += [(207, base[5].replace(base[5].split()[30], "edit"), "en", "a", 1), (208, 'token = "abcdef0123456789abcdef" x', "en", "a", 5)]
    return docs


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    nan, inf = float("nan"), float("inf")
    vectors = [(i, [((i * k) % 7 - 3) / 10 for k in range(1, 9)], 0) for i in range(120)]
    vectors += [(200 + i, [0.5] * 8, 0) for i in range(60)]  # ties
    vectors += [(300, None, 0), (350, [], 0), (400, [nan] + [0.1] * 7, 0), (450, [inf] * 8, 0), (500, [None] + [0.1] * 7, 0), (550, [1e7] * 8, 0), (600, [0.0] * 8, 0), (650, [0.1, 0.2], 0), (651, [0.3, -0.2], 0), (None, [0.1] * 8, 0)]
    labels = [(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(40)] + [(3, None, None), (999, 1, 0), (None, 1, 1)]
    return build(spark, str(tmp_path_factory.mktemp("edge")), edge_docs(), labels, vectors)


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    return build(spark, str(tmp_path_factory.mktemp("nothing")), [], [], [])


@pytest.fixture(scope="session")
def corpus():
    return "/root/testdata/sf0.01"
