"""Operators 11 to 13 against plain versions, SQL, and odd rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import rows_of, rows_of_sql
from pyspark.sql import functions as F

from ledgerlake.llm import fill_middle, learned_index, personal_data, registry, spelling_variants
from ledgerlake.llm.common import saved

ODD = [(1, None), (2, ""), (None, "x\n"), (3, "same Words 12"), (3, "same Words 12"), (4, "é<P>ü"), (5, "ab" * 200_000), (6, "1" * 100_000 + "@@@@" + "." * 1000), (7, "\0\x80ÿ𝒳a"), (8, "Á" * 50_001), (9, "1 " * 50_000 + "x")]
SCHEMA = "doc_id long, text string"


def with_clashes(df):
    """The same rows with columns of names that the operators use themselves."""
    for c in ("n", "word", "form", "root", "size", "key", "m", "row", "base", "spans", "output", "kind", "value", "gram", "a", "b"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def text_of(rng, parts, n):
    return "".join(rng.choice(parts) for _ in range(n))


# --- 11


def plain_cut(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text or "")
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text or ""
    spm = h[3] % 100 < 20
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [64, 4 << 20])
def test_cuts_equal_plain_ones(chunk, monkeypatch):
    monkeypatch.setattr(fill_middle, "CHUNK", chunk)
    rng = random.Random(5)
    texts = [text_of(rng, ["a", "Zz", "é", "中", "𝒳", " ", "\n", "1", "@", "[", "`", "{", "<P", ">", "S>"], rng.randrange(40)) for _ in range(3000)] + [t for _, t in ODD]
    ids = [*range(3000), *[i for i, _ in ODD]]
    got = list(fill_middle.cut_texts(pa.array(texts, pa.string()).slice(0), ids, fill_middle.Rates()))
    assert [(n, f, p, m, o.decode()) for n, f, p, m, o in got] == [plain_cut(i, t) for i, t in zip(ids, texts, strict=True)]
    assert {f for _, f, *_ in got} == {"plain", "psm", "spm"}


def test_cuts_of_a_sliced_column():
    column = pa.array(["abc d", "é f", None, "x"], pa.string()).slice(1)
    assert [r[4].decode() for r in fill_middle.cut_texts(column, [10, 11, 12], fill_middle.Rates())] == [plain_cut(i, t)[4] for i, t in ((10, "é f"), (11, None), (12, "x"))]


def test_fill_middle_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    rows = fill_middle.transformed(with_clashes(docs))
    rows = rows.withColumn("back", fill_middle.restored(F.col("form"), F.col("output")))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in rows.collect()), key=str)
    assert got == sorted(((i, *plain_cut(i, t), t or "") for i, t in ODD), key=str)
    assert fill_middle.transformed(docs.limit(0)).count() == 0


# --- 12


def plain_words(docs, noise=31):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, ratio=10):
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        if xs and words[x := min(xs, key=lambda x: (-words[x], x))] >= ratio * words[w]:
            form[w] = x
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def all_rows(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_vocabulary_of_odd_rows(spark):
    docs = [*ODD, *[(k, "Straßen-größere GRÖSSERE größere ×÷×÷×÷× abcdefg abcdefg hijklmno" * 3) for k in range(200)]]
    frame = with_clashes(spark.createDataFrame(docs, SCHEMA))
    got = {r.word: r.n for r in spelling_variants.vocabulary(frame).collect()}
    assert got == plain_words(docs)
    assert {r.word: r.n for r in spelling_variants.vocabulary(frame, noise=0).collect()} == plain_words(docs, 0)
    assert spelling_variants.variants(spelling_variants.vocabulary(frame.limit(0))).count() == 0


def test_variants_equal_plain_ones(spark):
    rng = random.Random(3)
    words = {}
    for _ in range(60):
        w = text_of(rng, list("abé"), rng.randrange(7, 14))
        words[w] = rng.randrange(2, 100_000)
        for _ in range(12):  # a crowd around each, with steps further on
            k, c = rng.randrange(len(w) + 1), rng.choice("abcéö")
            w2 = rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])
            if len(w2) >= 7:
                words.setdefault(w2, rng.choice([2, 3, 30, 300, 3000]))
                w = rng.choice([w, w2])
    words |= {"aaaaaaa": 10**15, "aaaaaaaa": 10**12, "aaaaaaaaa": 10**9, "aaaaaaaaaa": 10**6, "aaaaaaaaaaa": 1000, "aaaaaaaaaaaa": 5}
    got = all_rows(spelling_variants.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain_variants(words)
    assert max(len(w) for w, _, root, *_ in got if root == "aaaaaaa") == 12
    pairs = [tuple(sorted((r.a, r.b))) for r in spelling_variants.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long")).collect()]
    assert len(pairs) == len(set(pairs)) > 300


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_spelling_variants"])
def test_new_operators_equal_sql(spark, tmp_path, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(i, t) for i, t in ODD if t is None or "\0" not in t and len(t) < 100], SCHEMA))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows_of(registry.QUERIES[name](spark, str(tmp_path))) == rows_of_sql(con, registry.ORACLE[name])


# --- 13

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def checks(number):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(number))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def plain_base(text):
    if len(text or "") > 10_000:  # the very long odd rows hold no personal data, and plain patterns need hours for them
        return []
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(number) <= 19 and checks(number), "phone": 9 <= len(number) <= 15}[kind]
            out += [(m.start(), k, m.end())] if ok else []
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(9)
    parts = ["a", ".", "-", "@", "b.c", "1", "23", "255", "+", " ", "(", ")", "4111111111111111", "5", "%", "x@y.zz", "é", "1.2.3.4", "000", "\n"]
    for _ in range(20_000):
        t = text_of(rng, parts, rng.randrange(14))
        assert [s[:3] for s in personal_data.base_spans(t)] == plain_base(t), t
    long = "a@" * 100_000 + "1." * 100_000 + "+1 " * 100_000 + "(at)" * 100_000
    personal_data.candidates(long, personal_data.base_spans(long))  # in time that grows with the text


def plain_spans(docs, rounds=3, support=5, confident=700, accepted=800, doubt=2):
    """The rules of personal_data, by plain loops over all documents."""
    import math

    word = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+")
    low = lambda w: "".join(c.lower() if c < "\x80" else c for c in w)
    grams, edges, rows = Counter(), Counter(), []
    for _, t in docs:
        t = t or ""
        tokens = [low(w) for w in word.findall(t)]
        grams.update((w,) for w in tokens)
        grams.update(zip(tokens, tokens[1:], strict=False))
        base = personal_data.base_spans(t)
        more = personal_data.candidates(t, base)
        rows.append((base, more))
        for seed, spans in ((True, base), (False, more)):
            for s in spans:
                before, behind = [low(w) for w in word.findall(t[: s.start])][-2:], [low(w) for w in word.findall(t[s.end :])][:2]
                for side, near in ((0, before[-1:]), (0, before), (1, behind[:1]), (1, behind)):
                    if near and (len(near) == 2 or near is not before and near is not behind):
                        edges[s.kind, side, tuple(near), s.value, seed] += 1
    values = defaultdict(set)
    for kind, side, gram, value, _ in edges:
        values[kind, side, gram].add(value)
    edges = {k: n for k, n in edges.items() if len(values[k[:3]]) >= support}
    seeds = {(k[0], k[3]): 1000 for k in edges if k[4]}
    scores = dict(seeds)
    for _ in range(rounds):
        hits, counted = Counter(), defaultdict(set)
        for (kind, side, gram, value, _), n in edges.items():
            s = scores.get((kind, value), 0)
            hits[kind, side, gram] += n * s
            if s >= accepted:
                counted[kind, side, gram].add(value)
        sure = {p: min(999, h // (grams[p[2]] + doubt)) for p, h in hits.items() if len(counted[p]) >= support}
        sure = {p: c for p, c in sure.items() if c >= confident}
        doubts = Counter()
        for p, value in {(k[:3], k[3]) for k in edges}:
            if p in sure:
                doubts[p[0], value] += math.floor(math.log(1 - sure[p] / 1000) * 1000)
        new = {i: math.floor(1000 - 1000 * math.exp(d / 1000)) for i, d in doubts.items()}
        scores = {i: max(new.get(i, 0), seeds.get(i, 0)) for i in {*new, *seeds}}
    ok = {i for i, s in scores.items() if s >= accepted} | {(s.kind, s.value) for base, _ in rows for s in base}
    return [sorted({s[:3] for s in base} | {s[:3] for s in more if (s.kind, s.value) in ok}) for base, more in rows]


def contextual_docs():
    docs = [(1000 + k, f"Please call me on my phone number is +1 (555) 010-{1000 + k} or write, order no 2024{k:04d}17") for k in range(100)]
    docs += [(10 + k, f"My Phone Number is 555-{200 + k}-4567, mobile 555-{200 + k}-4567 daily.") for k in range(20)]  # found beside the seeds' words
    docs += [(60 + k, f"text mobile 555-{300 + k}-9999 daily") for k in range(3)]  # found beside the words of those found
    docs += [(70 + k, f"contact bob{k}@mail.example.org for help") for k in range(10)] + [(81, "contact ann (at) mail (dot) example (dot) org for help"), (82, "contact centre for help")]
    docs += [(90 + k, f"order no 5550{k:03d}99 was shipped with 4111111111111112") for k in range(30)]  # no personal data
    return docs


@pytest.mark.parametrize("most_sent", [1_000_000, 0])
def test_contexts_find_unseen_identifiers(spark, most_sent):
    docs = [*contextual_docs(), *ODD]
    rows = personal_data.personal_data(with_clashes(spark.createDataFrame(docs, SCHEMA)).repartition(5), most_sent=most_sent).collect()
    got = sorted(((r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in rows), key=str)
    assert got == sorted(((i, plain_base(t), s) for (i, t), s in zip(docs, plain_spans(docs), strict=True)), key=str)
    by_id = {i: s for i, _, s in got if i is not None}
    assert all(len(by_id[10 + k]) == 2 for k in range(20)) and all(by_id[60 + k] for k in range(3)) and by_id[81]
    assert not any(by_id[90 + k] for k in range(30)) and all(len(by_id[1000 + k]) == 1 for k in range(100))


def test_personal_data_query_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame(contextual_docs(), SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = dict(zip([i for i, _ in contextual_docs()], plain_spans(contextual_docs()), strict=True))
    text = dict(contextual_docs())
    told = lambda spans: ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    for r in registry.QUERIES["op13_personal_data"](spark, str(tmp_path)).collect():
        base = plain_base(text[r.doc_id])
        assert r.spans == told(want[r.doc_id]) and r.base_sha256 == hashlib.sha256(told(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in base) for k in range(4))
    assert personal_data.personal_data(saved(docs.limit(0), "none")).count() == 0


def test_learned_index_probes_some_parts_only(spark):
    """Clustered vectors, an index fitted on a tenth of them: recall against brute force over all, from a few of many parts."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 16))
    x = centre[rng.integers(40, size=5000)] + 0.25 * rng.normal(size=(5000, 16))
    vectors = saved(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, v array<double>"), "clustered")
    index = learned_index.fit(vectors, sample=500)
    parts = index.layers[-1][1].size
    assert parts == learned_index.parts_of(5000, 500) == 8 and index.probes < parts / 2
    got = {}
    for r in learned_index.search(vectors.where("vec_id % 50 = 0"), vectors, index).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[::50] @ u.T
    s[np.arange(100), np.arange(0, 5000, 50)] = -9
    best = np.argsort(-s, axis=1)[:, :5]
    found = sum(len(got[50 * q] & set(best[q].tolist())) for q in range(100))
    assert found >= 0.9 * 500, found


def test_text_methods_stay_in_their_module():
    assert os.path.basename(fill_middle.__file__) == "fill_middle.py" and {"op11_fill_middle", "op12_spelling_variants", "op13_personal_data"} <= set(registry.QUERIES)
