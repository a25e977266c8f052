"""Every operator against a plain version on the small tables, and on hand-made rows with nulls, ties, repeats and odd columns."""

import hashlib
import random
import tracemalloc
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from compare import rows_of, rows_of_sql
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlake.llm import byte_tokens, chat_format, learned_index, line_dedup, near_dedup, packing, quality_classifier, quality_rules, registry, sentence_pieces, sorted_tables, url_filter
from ledgerlake.llm.common import new_folder, table, tokenizer_file

DOC = "doc_id long, text string, lang string, source string, n_chars long, rid string, label string"
LONG = " ".join(f"word{k % 977}" for k in range(20_000))


def odd_documents(spark):
    a = "one two three four five six seven eight nine ten\nshort line\n" * 3
    rows = [(1, a), (2, a), (2, a), (3, None), (4, ""), (5, " \n\t\n"), (None, "text without an id but with words enough to shingle here"), (6, LONG), (7, "a<|endoftext|>b  c\n"), (8, LONG + " tail"), (9, "日本 ▁ x\x00y")]
    return spark.createDataFrame([(d, t, "en", None if d == 3 else "src", len(t or ""), "clash", "clash") for d, t in rows], DOC)


def documents(spark, sf_dir):
    return [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit(""))).collect()]


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    assert rows_of(registry.QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, registry.ORACLE[name])


def test_quality_rules_remove_common_lines(spark):
    body = "\n".join(f"own line {k} of this text with several words" for k in range(8))
    rows = [(k, f"{body} {k}\ncommon line here", "en", "a", 1, "", "") for k in range(5)] + [(9, "common line here", "en", "b", 1, "", "")]
    docs = spark.createDataFrame(rows, DOC)
    for few in (10, 0):  # by broadcast, by join
        got = {r.doc_id: r for r in quality_rules.judge(docs, min_docs=4, broadcast_rows=few, with_text=True).collect()}
        assert sorted(d for d, r in got.items() if "common" not in r.text) == [1, 2, 3, 4]  # the first keeps it, and so does another host
        assert got[1].removed_words == 3 + 7 * 9 and got[1].rid == ""
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_quality_rules_reject_depleted_documents(spark, tmp_path):
    import duckdb

    shared = "\n".join(" ".join(f"s{j}w{k}" for k in range(20)) for j in range(5))
    rows = [(k, shared + "\n" + " ".join(f"d{k}w{j}" for j in range(20)), "en", "a", 1, "", "") for k in range(30)]  # 100 of 120 words are shared
    rows += [(k, " ".join(f"d{k}w{j}" for j in range(120)), "en", "a", 1, "", "") for k in range(30, 60)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in quality_rules.query(spark, str(tmp_path)).collect()}
    assert [d for d, r in sorted(got.items()) if not r.kept] == list(range(1, 30))  # the first keeps the lines, so it stays
    assert not any(r.base_failed for r in got.values()) and {got[d].removed_words for d in range(1, 30)} == {100}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows_of(quality_rules.query(spark, str(tmp_path))) == rows_of_sql(con, quality_rules.SQL)


def test_quality_rules_clashing_names_and_repeated_rows(spark):
    rows = [(k % 6 if k < 18 else None, f"common line\nown {k % 6}", "a", "x", k, True, k, "o", 1, [k]) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `host` string, `n_words` int, `KEPT` boolean, `own` int, `text_hash` string, `odd name` int, `extra` array<int>")
    seen = []
    for few in (1000, 5, 0):  # repeated ids by broadcast, all ids made distinct, lines by join
        got = quality_rules.judge(docs, min_docs=4, max_percent=0, broadcast_rows=few, with_text=True)
        assert got.columns == ["doc_id", "text", "source", "host", "own", "text_hash", "odd name", "extra", *[x.split()[0] for x in quality_rules.MEASURES.split(", ")]]
        seen.append(sorted((r.own, r.text, r.n_words, r.removed_words, r["odd name"], tuple(r.extra)) for r in got.collect()))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 20
    assert all((removed == 0) == (own < 18 and own % 6 == 0) for own, _, _, removed, _, _ in seen[0])  # six ids and null: the least one keeps the line
    assert {r[2] for r in seen[0]} == {4}
    assert quality_rules.common_lines(docs, 6, 0).count() == 1 and quality_rules.common_lines(docs, 7, 0).count() == 0  # seven documents, not twenty


def test_quality_rules_same_rows_as_sql_where_lines_go(spark, tmp_path):
    import duckdb

    body = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{body} {k}\nShared  line {k % 2}\nonly here {k}", "en", "a" if k < 450 else "b", 1, "", "") for k in range(500)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = rows_of(quality_rules.query(spark, str(tmp_path)))
    assert got == rows_of_sql(con, quality_rules.SQL)
    at = got[0].index("removed_words")
    assert sum(r[at] == "3" for r in got[1]) == 496  # all but the first of each line in its host


def test_quality_rules_on_odd_rows(spark):
    got = {r.doc_id: r for r in quality_rules.judge(odd_documents(spark)).collect()}
    assert got[3].n_words == 0 and got[3].base_failed and not got[3].kept
    assert got[1].n_dup_lines == 4 and got[1].n_repeat_words == got[1].n_words == 36


def packed_rows(spark, docs, size=packing.LENGTH):
    rows = packing.packed(docs, size).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return rows, by


def test_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows, by = packed_rows(spark, docs)
    total = sum(r.length for r in rows)
    assert len(by) <= 1.03 * -(-total // packing.LENGTH)
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    for doc, text in documents(spark, sf_dir):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)


def test_packing_odd_rows(spark):
    rows, _ = packed_rows(spark, odd_documents(spark))
    assert sum(r.doc_id == 2 for r in rows) == 2 and [r.length for r in rows if r.doc_id == 3] == [1]
    assert packing.packed(odd_documents(spark).limit(0)).count() == 0


def test_most_sequences_come_from_fitted_patterns(spark, sf_dir):
    h = np.zeros(packing.LENGTH + 1, dtype=np.int64)
    for r in packing.cut(table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")).groupBy("length").count().collect():
        h[r.length] = r["count"]
    plan = packing.plan(h)
    h[packing.LENGTH] = 0
    used = np.zeros_like(h)
    for own, n in plan:
        for v in own:
            used[v] += n
    assert (used == h).all()
    full = sum(n for own, n in plan if sum(own) == packing.LENGTH and len(own) <= 3)
    least = -(-int((h * np.arange(len(h))).sum()) // packing.LENGTH)
    assert sum(n for _, n in plan) <= least + 3 and full >= 0.65 * least


def test_patterns_fill_a_sequence():
    ways = packing.patterns(24)
    assert (ways.sum(axis=1) == 24).all() and len({tuple(w) for w in ways}) == len(ways)
    h = np.zeros(25)
    h[[8, 16, 24, 5]] = [30, 12, 4, 1]
    used = np.zeros(25, dtype=int)
    for own, n in packing.plan(h):
        assert sum(own) <= 24
        for v in own:
            used[v] += n
    assert used[8] == 30 and used[16] == 12 and used[5] == 1 and used[24] == 0


def test_url_filter_odd_rows(spark):
    urls = ["http://A.ORG/x", "https://org/", "ftp://notorg/", "http://www.Example.org/en/1?x", "http://example.org/en/2", "http://example.org", "nothing", None, "http://x.com/de/a#b", "http://x.com/deep/", "a://b://c.org/", "http://x.com/fr/?u=http://y.com/de/", ""]
    pages = spark.createDataFrame([(k % 11, u, "x") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {(r.host, r.path): (r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rules_frame(spark, url_filter.RULES)).collect()}
    assert got[("a.org", "/x")] == ("org/", "allow") and got[("org", "/")] == ("org/", "allow") and got[("notorg", "/")] == (None, "allow")
    assert got[("www.example.org", "/en/1")] == ("example.org/en/1", "block") and got[("example.org", "/en/2")] == ("org/", "allow")
    assert got[("example.org", "")] == (None, "allow") and got[("", "")] == (None, "allow")
    assert got[("x.com", "/de/a")] == ("com/de/", "block") and got[("x.com", "/deep/")] == (None, "allow") and got[("x.com", "/fr/")] == ("com/fr/", "allow")
    assert url_filter.judge(pages, url_filter.rules_frame(spark, url_filter.RULES)).count() == len(urls)
    plan = url_filter.judge(pages, url_filter.rules_frame(spark, url_filter.RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_url_filter_has_no_limit_to_rules(spark):
    """12,000 combinations of labels and path lengths, against each URL and rule by itself."""
    draw = random.Random(3)
    host = lambda n: ".".join(draw.choice("ab") for _ in range(n))
    rules = {("a" if n == 1 else host(n), "/" + "p" * (k - 1)): draw.choice(["allow", "block"]) for n in range(1, 31) for k in range(1, 401)}
    hosts = sorted({h for h, _ in rules})
    urls = [f"x://{draw.choice(['', 'c.', 'a.'])}{draw.choice(hosts)}/{'p' * draw.randrange(420)}{draw.choice(['', 'q', '?p'])}" for _ in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], "host string, path string, verdict string")
    for r in url_filter.judge(pages, frame).collect():
        fits = [(len(h + p), h + p, v) for (h, p), v in rules.items() if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == (max(fits)[1:] if fits else (None, "allow"))
    assert url_filter.judge(pages, frame.limit(0)).where("rule IS NULL AND verdict = 'allow'").count() == len(urls)
    assert url_filter.judge(pages.limit(0), frame).count() == 0


def test_line_dedup(spark, sf_dir):
    want = brute.similar_lines(documents(spark, sf_dir))
    for block in (line_dedup.BLOCK, 40):  # with tiles too
        got = {r.doc_id: list(r.removed) for r in line_dedup.removals(table(spark, sf_dir, "documents"), block=block).collect()}
        assert got == want


def test_line_dedup_chains_and_near_copies(spark):
    base = [f"t{k}" for k in range(20)]
    rows = []
    for k in range(40):  # each is like its neighbours only
        w = [*base[k % 20 :], *(f"u{j}" for j in range(k % 20))]
        rows.append((k, " ".join(w), "en", "a", 0, "", ""))
    rows.append((50, None, "en", "a", 0, "", ""))
    docs = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: list(r.removed) for r in line_dedup.removals(docs).collect()}
    assert got == brute.similar_lines([(r[0], r[1]) for r in rows])
    left = {r.doc_id: r.text for r in line_dedup.apply(docs).collect()}
    assert left[0] == rows[0][1] and left[20] == "" and left[50] is None


def test_line_dedup_short_lines(spark, sf_dir):
    texts = ["a\na b\na b c\na b c d", "b a\nd c b a e\n\nc a b x\na a", "a b c\nd a b c e f\n \n a ", "e f g h i\ni h g f\ng f i"]
    rows = [(k, t, "en", "a", 0, "", "") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOC)
    want = brute.similar_lines([(r[0], r[1]) for r in rows])
    assert want == {0: [], 1: [0, 1, 4], 2: [0, 1, 3], 3: [1]}  # four of five words are similar, three of four aren't
    assert {r.doc_id: list(r.removed) for r in line_dedup.removals(docs).collect()} == want
    left = {r.doc_id: r.text for r in line_dedup.apply(docs).collect()}
    assert left == {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[k]) for k, t in enumerate(texts)}
    whole = brute.similar_lines(documents(spark, sf_dir))
    got = {r.doc_id: r.removed_lines for r in line_dedup.query(spark, sf_dir).collect()}
    assert got == {d: ",".join(map(str, gone)) for d, gone in whole.items()}


def test_line_dedup_odd_rows(spark):
    out = line_dedup.apply(odd_documents(spark))
    assert out.columns == odd_documents(spark).columns and out.count() == 11
    clash = odd_documents(spark).toDF("doc_id", "text", "_gone", "removed", "text_hash", "doc", "own_doc")
    assert line_dedup.apply(clash).columns == clash.columns and line_dedup.apply(clash).where("removed = 'src'").count() == 10
    assert line_dedup.removals(odd_documents(spark).limit(0)).count() == 0


def test_line_dedup_verifies_many_tokens_in_little_memory(monkeypatch):
    rng, groups, size, n = np.random.default_rng(1), 100, 30, 200
    sets = []
    for _ in range(groups):
        spare = iter(rng.integers(0, 1 << 61, 60 * size).tolist())
        base = [*rng.integers(0, 1 << 61, 150).tolist(), *(line_dedup.RANKED + rng.choice(1 << 17, 50, replace=False)).tolist()]
        sets += [{*base[k:], *(next(spare) for _ in range(k))} for k in rng.integers(0, 60, size).tolist()]
    keys = [sorted(s) for s in sets]
    rest, rank = ([[k for k in row if (k >= line_dedup.RANKED) == often] for row in keys] for often in (False, True))
    low = [sum(k < line_dedup.RANKED + (1 << 16) for k in row) for row in rank]
    number, zero = np.arange(len(sets)), np.zeros(len(sets), dtype=np.int64)
    packed = [pa.array([np.array(row, dtype=kind).tobytes() for row in rows]) for rows, kind in ((rest, "<u8"), ([[k - line_dedup.RANKED & 0xFFFF for k in row] for row in rank], "<u2"))]
    t = pa.table({"set": number, "doc": number, "line": zero.astype(np.int32), "shape": zero + (n << 32), "b0": zero, "b1": zero, "low": pa.array(low, pa.int32()), "rest": packed[0], "rank": packed[1]})
    want = [i for i in range(len(sets)) if any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(i - i % size, i))]
    assert len(sets) > len(want) > 0
    tracemalloc.start()
    got = line_dedup._late(t, number // size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.column("set").to_pylist() == want
    assert peak < 50 * len(sets) * n
    for most in (n // 2, 3 * n + 1):  # one set alone, and a few
        monkeypatch.setattr(line_dedup, "TOKENS_AT_ONCE", most)
        assert line_dedup._late(t, number // size).column("set").to_pylist() == want


def test_sentence_pieces(spark, sf_dir):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in sentence_pieces.digests(table(spark, sf_dir, "documents")).collect()}
    for doc, text in documents(spark, sf_dir):
        ids = library.encode(text)
        r = got[doc]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_sentence_pieces_random_text():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    codec, draw = sentence_pieces.Codec(keep=500), random.Random(5)
    letters = "aeiouthnsr .,  \n\té▁日本😀\x00<s>0x"
    for _ in range(3000):
        t = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        ids = library.encode(t)
        assert codec.encode(t) == ids and codec.decode(ids) == library.decode(ids)
        n, _, _ = codec.digest(t)
        assert n == len(ids)
    assert codec.decode([3 + 0xE2, 3 + 0x91]) == library.decode([3 + 0xE2, 3 + 0x91])


def test_near_dedup(spark, sf_dir):
    want, border = brute.near_classes(documents(spark, sf_dir), margin=0.01)
    got = {r.doc_id: r.class_id for r in near_dedup.classified(table(spark, sf_dir, "documents")).collect()}
    near_border = {d for pair in border for d in pair}
    assert {d: c for d, c in got.items() if d not in near_border} == {d: c for d, c in want.items() if d not in near_border}


def test_near_dedup_groups_and_odd_rows(spark):
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(60):  # copies that differ in one word each
        w = list(base)
        w[k * 4 + 3] = f"x{k}"
        rows.append((100 + k, " ".join(w)))
    rows += [(k, " ".join(f"v{k}_{j}" for j in range(100))) for k in range(5)]
    docs = spark.createDataFrame([(d, t, "en", "a", 0, "", "") for d, t in rows], DOC).unionByName(odd_documents(spark).where("doc_id IS NULL OR doc_id > 4"))
    for block in (near_dedup.BLOCK, 16):
        got = {r.doc_id: r.class_id for r in near_dedup.classified(docs, block=block).collect() if r.doc_id is not None}
        assert {got[d] for d, _ in rows if d >= 100} == {100} and [got[k] for k in range(5)] == [0, 1, 2, 3, 4]
        assert got[8] == got[6] == 6
    kept = near_dedup.keep_one(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 5, 6, 7, 9]
    assert near_dedup.keep_one(docs.limit(0)).count() == 0
    clash = odd_documents(spark).toDF("doc_id", "text", "_hash", "text_hash", "kept", "own_hash", "c0")
    assert near_dedup.keep_one(clash).columns == clash.columns


def test_sampling_estimates_weighted_jaccard():
    draw = np.random.default_rng(1)
    sampler, hits, want = near_dedup.Sampler(), [], []
    for _ in range(60):
        s = np.unique(draw.integers(1 << 63, size=300, dtype=np.int64).astype(np.uint64))
        a, b = s[: 3 * len(s) // 4], s[len(s) // 4 :]
        la, lb = draw.integers(36, size=len(a)), draw.integers(36, size=len(b))
        wa, wb = np.exp(la / near_dedup.FINE), np.exp(lb / near_dedup.FINE)
        out = sampler.sample(np.concatenate([a, b]), np.concatenate([la, lb]), np.array([len(a), len(b)]))
        hits.append((out[0] == out[1]).mean())
        _, i, j = np.intersect1d(a, b, return_indices=True)
        low = np.minimum(wa[i], wb[j]).sum()
        want.append(low / (wa.sum() + wb.sum() - low))
    assert abs(np.mean(hits) - np.mean(want)) < 0.03


def test_learned_index_recall(spark, sf_dir):
    vectors = {r.vec_id: list(r.embedding) for r in table(spark, sf_dir, "embeddings").collect()}
    want = brute.nearest(vectors, [v for v in vectors if v % 50 == 0])
    got = {}
    for r in learned_index.query(spark, sf_dir).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got.keys() == want.keys() and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    found = sum(len({v for v, _ in got[q].values()} & {v for _, v in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    exact = {(q, v): -s for q in want for s, v in want[q]}
    assert all(abs(exact[q, v] - s) < 1e-12 for q, g in got.items() for v, s in g.values() if (q, v) in exact)


def test_learned_index_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(learned_index, "BLOCK", 7)
    rows = [(k, [1.0, 2.0, 0.5]) for k in range(40)] + [(100, [0.0, 0.0, 0.0]), (150, None), (200, [1.0, None, 2.0]), (250, [float("nan"), 1.0, 1.0]), (300, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (0, [1.0, 2.0, 0.5]), (350, [1e200, 2e200, 1e199])]
    vectors = learned_index.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert vectors.count() == 43
    got = sorted((r.query_id, r.rank, r.vec_id) for r in learned_index.search(vectors.where("vec_id = 0"), vectors, learned_index.fit(vectors), block=7).collect())
    assert got == sorted([(0, k, k - 1) for k in range(1, 6)] * 2)  # equal vectors: the smaller ids; either row of id 0 has the other as its nearest
    assert learned_index.search(vectors.limit(0), vectors, learned_index.fit(vectors)).count() == 0


def test_learned_index_rows_of_other_lengths_and_equal_ids(spark):
    draw = np.random.default_rng(5)
    rows = [(k % 700, draw.normal(size=24 if k % 7 else 9).tolist()) for k in range(1400)]  # two rows for every id, a seventh of them of another length
    vectors = learned_index.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    index = learned_index.fit(vectors)
    assert vectors.count() == 1400 and index.length == 24 and index.layers
    got = {}
    for r in learned_index.search(vectors.where("vec_id % 50 = 0"), vectors, index).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    right = total = 0
    for query in range(0, 700, 50):
        for own in (query, query + 700):
            q = np.array(rows[own][1])
            near = [(-(q @ v) / (np.linalg.norm(q) * np.linalg.norm(v)), rows[k][0]) for k in range(1400) if k != own and len(v := np.array(rows[k][1])) == len(q)]
            want = {(v, round(-s, 9)) for s, v in sorted(near)[:5]}
            found = want & {(v, round(s, 9)) for _, v, s in got[query]}
            assert len(q) == 24 or found == want  # other lengths are searched whole
            right, total = right + len(found), total + len(want)
        assert sorted(r for r, _, _ in got[query]) == sorted([1, 2, 3, 4, 5] * 2)
    assert right >= 0.9 * total


def test_chat_format(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", chat_format.ADDED_TEXT), (-7, 1, "assistant", chat_format.ADDED_TEXT)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.query(spark, sf_dir).collect()}
    assert got == brute.conversation_digests(rows)


def test_chat_layouts():
    import json

    known = chat_format.mappings()
    want = [("user", "q"), ("assistant", "a")]
    for record in ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"prompt": "q", "response": "a"}, {"question": "q", "answer": "a"}, {"instruction": "q", "output": "a"}):
        assert chat_format.canonical(json.dumps(record), known)[1] == want
    assert chat_format.canonical(json.dumps({"instruction": "q", "input": "i", "output": "a"}), known)[1] == [("user", "q\n\ni"), ("assistant", "a")]
    assert chat_format.canonical('{"x": 1}', known)[2] == "no mapping has this fingerprint"
    assert chat_format.canonical("{", known)[2].startswith("not JSON") and chat_format.canonical(None, known)[1] is None
    for text in ("\\", "<turn user>", "</turn>\n", "\\<", "a>b", "", "\n"):
        formatted, mask = chat_format.render([("user", text), ("a<b>", text), ("assistant", text)])
        assert chat_format.parse(formatted) == [("user", text), ("a<b>", text), ("assistant", text)]
        assert [chat_format.unescape(formatted[a:b]) for a, b in mask] == [text]


def test_chat_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (None, 3, "assistant", "x\ty\u2028"), (2, None, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.read_back(chat_format.format_records(chat_format.records_of(df))).collect()}
    assert got == {1: (3, 0), None: (1, 4), 2: (1, 0)}


def test_sorted_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    manifest = sorted_tables.write_shards(docs, new_folder(spark, "shards"), shard_bytes=40_000)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in sorted_tables.read_shards(manifest).collect()}
    library, at, want, ids = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), 0, {}, {}
    for doc, text in sorted(documents(spark, sf_dir)):
        ids[doc] = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want[doc] = (at, len(ids[doc]), zlib.crc32(ids[doc].tobytes()))
        at += len(ids[doc])
    assert got == want
    readers = [sorted_tables.Reader(r.path) for r in manifest.orderBy("first_key").collect()]
    assert len(readers) > 4
    for doc in list(ids)[:40]:
        hits = [x for x in (r.get(doc) for r in readers) if x is not None]
        assert len(hits) == 1 and (hits[0] == ids[doc]).all()
    assert all(r.get(10**12) is None for r in readers)


def test_sorted_tables_odd_rows(spark):
    rows = sorted_tables.read_shards(sorted_tables.write_shards(odd_documents(spark), new_folder(spark, "shards"))).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert sorted_tables.read_shards(sorted_tables.write_shards(odd_documents(spark).limit(0), new_folder(spark, "shards"))).count() == 0


def test_byte_tokens_random_text():
    encoder, draw = byte_tokens.Encoder(keep=200), random.Random(2)
    assert encoder.cuts and encoder.spells
    letters = "ab Zé,.!'s t\n1²_\t ñ \x1c日😀<|endoftext|>-\u2003"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(5000)] + ["it's, don't' x'll", "a,b c.d,\ne.", "<|endoftext|> x"]
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert np.frombuffer(next(encoder.encode(pa.array(["a <|endoftext|> b"]))), "<u4").tolist() == [64, 220, 50256, 275]


def test_words_of_texts():
    from ledgerlake.llm import words

    draw = random.Random(4)
    texts = ["".join(draw.choice("abé日 \n\t\r\x00\u00a0-") for _ in range(draw.randint(0, 40))) for _ in range(2000)] + ["x" * 300 + " " + "y" * 17, None, "z" * 5000]
    for most in (100, 1 << 20):
        got, lines, seen = [], [], {}
        for w in words.chunks(pa.array(texts), most):
            spelt = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end)]
            for x, h in zip(spelt, w.hashes().tolist()):
                assert seen.setdefault(x, h) == h
            got += list(zip((w.text + w.first).tolist(), w.lines().tolist(), spelt))
            lines += w.line_counts().tolist()
        assert got == [(i, k, x) for i, t in enumerate(texts) for k, line in enumerate((t or "").encode().split(b"\n")) for x in line.split()]
        assert lines == [(t or "").count("\n") + 1 for t in texts] and len(set(seen.values())) == len(seen)


def test_nearest_of_huge_and_tiny_vectors():
    q = np.array([[1.0, 2.0, 0.5]])
    v = np.stack([q[0] * 1e200, q[0] * 1e-200, [2.0, 1.0, 0.5]])
    for scale in (1.0, 1e200, 1e-200):
        _, ids, score = learned_index.best_of(np.array([9]), q * scale, np.array([1, 2, 3]), v, 3)
        assert sorted(ids[:2]) == [1, 2] and ids[2] == 3 and np.allclose(score, [1, 1, 4.25 / 5.25], rtol=1e-15)


def test_quality_rules_same_rows_as_sql_on_more_documents(spark, sf_dir):
    import duckdb

    big = sf_dir.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{big}/documents.parquet'")
    got = rows_of(quality_rules.query(spark, big))
    assert got == rows_of_sql(con, quality_rules.SQL)
    at = got[0].index("removed_words")
    assert sum(r[at] != "0" for r in got[1]) > 0


def test_quality_classifier(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in table(spark, big, "labels").collect()}
    rows = quality_classifier.query(spark, big).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_quality_scores_by_plain_compression(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    rows = quality_classifier.query(spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count() and all(abs(r.score - brute.quality(model, texts[r.doc_id])) < 1e-9 for r in rows)


def test_quality_classifier_learns_the_same_however_rows_lie(spark):
    rows = [(k % 40, f"{'good words ' if k % 2 else 'bad noise ' * 2}" * 30 + f"{k}") for k in range(120)]  # three texts for each id
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, 0)], "doc_id long, quality int")
    models = [quality_classifier.fit(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 3), (rows[::-1], 7))]
    assert models[0] == models[1] is not None


def test_quality_classifier_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (99, 0)], "doc_id long, quality int")
    model = quality_classifier.fit(odd_documents(spark), labels)
    out = quality_classifier.score(odd_documents(spark), model)
    assert model is None and out.count() == 11 and out.where("score <> 0.5").count() == 0
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)], "doc_id long, quality int")
    scored = quality_classifier.score(odd_documents(spark), quality_classifier.fit(odd_documents(spark), labels))
    assert scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
