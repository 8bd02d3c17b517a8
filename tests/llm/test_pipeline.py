"""The pipeline's stages against a brute-force version, and the checks of its contract."""

from __future__ import annotations

import random

import pyarrow as pa

import corpus_pipeline
from factgraph.llm import packing, quality


def test_pipeline_matches_brute_force(spark, tmp_path):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(900)]
    shared = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for k in range(16):
        words = [r.choice(vocabulary) for _ in range(r.randint(60, 140))]
        texts.append(" ".join(words))
        if k % 4 == 0:
            texts.append(" ".join([*words[:-1], "other"]))  # near copy
        if k % 3 == 0:
            texts.append(" ".join(words[5:40] + shared + vocabulary[k * 40 : k * 40 + 40]))
    texts += ["too short", "a b c " * 60, None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))

    docs, seen = df, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
        seen.append({x["doc_id"]: x["text"] for x in docs.collect()})
    verdict = quality.measure(pa.array(texts, pa.string()), quality.Rules())["kept"]
    one = {i: t for i, t in enumerate(texts) if verdict[i]}
    assert seen[0] == one

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in one.items()}
    label = {i: i for i in one}
    for _ in one:
        for i in one:
            for j in one:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    two = {i: t for i, t in one.items() if label[i] == i}
    assert seen[1] == two and len(two) < len(one)
    known, three = set(), {}
    for i, t in sorted(two.items()):
        w, gone = t.split(), set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if g in known else set()
            known.add(g)
        three[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
    assert seen[2] == three and three != two
    enc = packing.Encoder(packing.TOKENIZER)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total: dict[int, int] = {}
    for x in out:
        total[x["doc_id"]] = total.get(x["doc_id"], 0) + x["length"]
    ids, at = enc.encode(pa.array(list(three.values())))
    assert total == {i: int(at[k + 1] - at[k]) + 1 for k, i in enumerate(three)}
