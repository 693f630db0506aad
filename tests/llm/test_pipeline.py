"""The pipeline against a plain version of each stage, document by document."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers

from cairn.llm import op3_rules, op4_secrets, op5_toxicity
from cairn.llm.textnum import Texts, features
from tests.llm.test_operators import brute_classes, brute_statistics


def is_toxic(model, text):
    low = "".join(c.lower() if c < "\x80" or ("À" <= c <= "Þ" and c != "×") else c for c in text).encode()
    found = Counter()
    for word in re.findall(rb"[a-z0-9\x80-\xff]+", low):
        whole = Texts([word])
        found[int(whole.hashes(whole.start, whole.end)[0])] += 1
        for k in op5_toxicity.PREFIXES:
            if len(word) > k:
                found[int(whole.hashes(whole.start, whole.start + k)[0]) ^ k] += 1
    weight = dict(zip(model.term.tolist(), model.weight, strict=True))
    z = sum(weight[t] * (1 + np.log(n)) for t, n in found.items() if t in weight)
    return sum(1 / (1 + np.exp(-(z - theta))) for theta in model.theta) >= model.cut


def passes(forest, text):
    n, _, _, _, repeated = brute_statistics(text)
    if n < 20 or 100 * repeated > 30 * n:
        return False
    x, total = features(Texts([text.encode()]))[1][0], forest.bias
    for i in forest.root:
        while forest.left[i] != i:
            i = forest.left[i] if x[forest.feature[i]] <= forest.cut[i] else forest.right[i]
        total += forest.value[i]
    return 1 / (1 + np.exp(-total)) >= op3_rules.KEEP_FROM


def without_secrets(text):
    covered = sorted((s, e) for s, _, e in op4_secrets.find(text))
    out, at = "", 0
    for s, e in covered:
        if s >= at:
            out += text[at:s] + "[secret]"
        at = max(at, e)
    return out + text[at:]


def test_pipeline_against_a_plain_one(spark, small):
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    want = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "toxicity":
            model = op5_toxicity.fit_toxicity(docs, labels)
            want = {i: t for i, t in want.items() if not is_toxic(model, t)}
        elif name == "quality_rules":
            forest = op3_rules.fit_rules(docs, labels)
            want = {i: t for i, t in want.items() if passes(forest, t)}
        elif name == "near_duplicates":
            first = brute_classes(list(want.items()))
            want = {i: t for i, t in want.items() if first[i] == i}
        else:
            want = {i: without_secrets(t) for i, t in want.items()}
        docs = stage(spark, docs, small)
        assert docs.columns == columns
        assert {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()} == want
    assert 0 < len(want) < 200
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, lengths = defaultdict(list), Counter()
    for r in corpus_pipeline.run(spark, small).collect():
        pieces[r["doc_id"]].append(r)
        lengths[r["sequence_id"]] += r["length"]
    assert set(pieces) == set(want) and all(n == 4096 or n & (n - 1) == 0 for n in lengths.values())
    for i, parts in pieces.items():
        ids = np.array([*model.encode(want[i], add_special_tokens=False).ids, 2], dtype="<u4")
        parts.sort(key=lambda r: r["start"])
        assert [p["start"] for p in parts] == [sum(p["length"] for p in parts[:k]) for k in range(len(parts))]
        assert b"".join(ids[p["start"] : p["start"] + p["length"]].tobytes() for p in parts) == ids.tobytes()
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) and p["doc_tokens"] == len(ids) for p in parts)
