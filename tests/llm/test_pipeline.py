import zlib
from collections import defaultdict

import brute
import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from ledgerlake.llm import near_dedup, quality_classifier, quality_rules
from ledgerlake.llm.common import saved, table, tokenizer_file


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, sf_dir), name)
        if name != "best_fit_packing":
            assert out.columns == columns and out.schema == docs.schema
        seen.append((name, docs, out))
        docs = out
    before, after = {n: b for n, b, _ in seen}, {n: a for n, _, a in seen}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    model = quality_classifier.fit(before["quality_classifier"], table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(before["quality_classifier"], model)
    assert ids(after["quality_classifier"]) == ids(scored.where("score >= 0.3"))
    assert ids(after["quality_rules"]) == ids(quality_rules.judge(before["quality_rules"]).where("kept"))
    assert ids(after["line_dedup"]) == ids(before["line_dedup"])
    classes = near_dedup.classified(before["near_dedup"]).collect()
    assert after["near_dedup"].count() == len({r.class_id for r in classes})
    assert ids(after["best_fit_packing"]) == ids(before["best_fit_packing"])


def test_run_gives_the_last_stage(spark, sf_dir):
    assert set(corpus_pipeline.run(spark, sf_dir).columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_run_gives_the_rows_of_plain_stages(spark, sf_dir, tmp_path):
    from tokenizers import Tokenizer

    docs = table(spark, sf_dir, "documents").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, sf_dir, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    rows = [(r.doc_id, r.text or "", r.source) for r in docs.collect()]
    good = [r for r in rows if brute.quality(model, r[1]) >= 0.3]
    ruled = brute.passed_rules(good)
    gone = brute.similar_lines(list(ruled.items()))
    cut = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in ruled.items()}
    classes, border = brute.near_classes(list(cut.items()), margin=0.01)
    one = {d: cut[d] for d, c in classes.items() if d == c}
    assert not border and len(rows) > len(good) > len(ruled) > len(one)
    assert any(t != ruled[d] for d, t, _ in good if d in ruled) and any(gone.values())

    encoder = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    ids = {d: encoder.encode(t, add_special_tokens=False).ids + [2] for d, t in one.items()}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for d, got in pieces.items():
        got.sort()
        assert [p for p, *_ in got] == list(range(len(got))) and (len(got) == 1) == (len(ids[d]) <= 1024)
        assert [s for _, s, *_ in got] == [sum(n for _, _, n, _ in got[:k]) for k in range(len(got))]
        assert sum(n for _, _, n, _ in got) == len(ids[d])
        assert all(c == zlib.crc32(np.array(ids[d][s : s + n], dtype="<u4").tobytes()) for _, s, n, c in got)
    for got in places.values():
        got.sort()
        assert [o for o, _ in got] == [sum(n for _, n in got[:k]) for k in range(len(got))] and sum(n for _, n in got) <= 1024
