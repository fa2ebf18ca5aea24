import hashlib
from collections import Counter

from helpers import DATA


def test_stages(spark, odd):
    import corpus_pipeline as p
    import sentencepiece

    from folioframe.llm import pieces, toxicity
    from folioframe.llm.common import documents, fold, labels, stored
    from folioframe.llm.simhash import fingerprint
    from pyspark.sql import functions as F

    docs = documents(spark, DATA)
    columns = docs.columns
    tables = [docs]
    for _, stage in p.STAGES:
        tables.append(stored(stage(spark, tables[-1], DATA)))
        assert len(tables) == len(p.STAGES) + 1 or tables[-1].columns == columns
    raw, clean, unique, apart, mixed, encoded = [t.collect() for t in tables]
    model = toxicity.train(toxicity.labelled_rows(docs, labels(spark, DATA), "toxic", fold(F.col("doc_id"), 4) != 2))
    scores = model.scores([r.text for r in raw])
    assert Counter(r.doc_id for r in clean) == Counter(r.doc_id for r, s in zip(raw, scores, strict=True) if s < toxicity.THRESHOLD)
    best = {}
    for r in clean:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(best.values()) == sorted(r.doc_id for r in unique)
    prints = [fingerprint(r.text) for r in unique]
    group = list(range(len(unique)))
    for i in range(len(unique)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for r, g in zip(unique, group, strict=True):
        least[g] = min(least.get(g, 1 << 60), r.doc_id)
    assert sorted(least.values()) == sorted(r.doc_id for r in apart)
    assert {tuple(r) for r in mixed} <= {tuple(r) for r in apart} and max(Counter(r.doc_id for r in mixed).values()) <= 3
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.tokenizer_path("piece_bpe_32k.model"))
    want = Counter((r.doc_id, hashlib.sha256(",".join(map(str, library.encode(r.text))).encode()).hexdigest()) for r in mixed)
    assert Counter((r.doc_id, r.ids_sha256) for r in encoded) == want
    assert Counter(map(tuple, p.run(spark, DATA).collect())) == Counter(map(tuple, encoded))


def test_the_driver_gets_its_memory_back(spark, odd, monkeypatch):
    """Every stage begins with it, and what the mixing stage returns is planned without the draw before it."""
    import corpus_pipeline as p
    from folioframe.llm import mixing

    began = []
    monkeypatch.setattr(p, "relieve_driver", lambda s: began.append(s))
    for module, name in ((p.toxicity, "drop_toxic"), (p.exact_dedup, "drop_exact_duplicates"), (p.simhash, "drop_near_duplicates"), (p.mixing, "mix_documents"), (p.pieces, "encode_decode")):
        monkeypatch.setattr(module, name, lambda docs, *_: docs)
    for _, stage in p.STAGES:
        stage(spark, odd, DATA)
    assert len(began) == len(p.STAGES)
    monkeypatch.undo()
    plan = mixing.mix_documents(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "LogicalRDD" not in plan
