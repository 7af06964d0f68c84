"""Tokenizing, coding, packing, token counts, classifiers and rules against brute force."""

import collections
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postbag.llm import langmix, packing, qda, queries, rangecoder, rules, separators, toxicity
from postbag.llm.tokens import ChunkEncoder, HashTable

SF = "/root/testdata/sf0.001"
PATH = P.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "<|endoftext|> x<|startoftext|>y", "don't\tit's ok", "İstanbul ΣΑΣ é x y", "̈foo _a_b 12ab3 🎉🎉x", "a\x00b \x1c\x85 z", "\n\n a b\n", "x" * 5000, "the " * 3000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(100_000 + i, t, None, "odd", 0) for i, t in enumerate(ODD)], SCHEMA)
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).union(odd).withColumn("rank", F.lit(1)).withColumn("part", F.lit("x")).cache()


@pytest.fixture(scope="module")
def truth(docs):
    t = Tokenizer.from_file(PATH)
    return {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_chunk_encoder():
    enc = ChunkEncoder(PATH, cache=5)  # starts anew all the time
    for _ in range(2):
        ids, counts = enc.encode(pa.array(ODD))
        want = [enc.full.encode(t or "", add_special_tokens=False).ids for t in ODD]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_hash_table():
    t, keys = HashTable(4), np.random.default_rng(0).integers(1, 1 << 62, 5000, dtype=np.uint64)
    t.add(keys[:2500])
    t.add(keys[2500:])
    assert (t.find(keys) == np.arange(5000)).all() and (t.find(keys + np.uint64(1)) == -1).all()


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 9000])
@pytest.mark.parametrize("high", [2, 500, 65_536])
def test_codec_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n).astype(np.uint16)
    assert (rangecoder.unpack(rangecoder.pack(ids)) == ids).all()


def test_codec_finds_damage_and_compresses():
    ids = np.tile(np.arange(300, dtype=np.uint16), 30)
    data = bytearray(rangecoder.pack(ids))
    assert len(data) < len(ids)
    data[-40] ^= 0x55
    with pytest.raises(ValueError):
        rangecoder.unpack(bytes(data))
    with pytest.raises(ValueError):
        rangecoder.pack(np.array([70_000]))


def test_token_file(docs, truth):
    got = rangecoder.read_documents(rangecoder.write_tokens(docs)).orderBy("doc_id").collect()
    start = 0
    assert [r.doc_id for r in got] == sorted(truth)
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(truth[r.doc_id]), crc(truth[r.doc_id]))
        start += r.n_tokens


def test_packing(docs, truth):
    packed = packing.pack(docs)
    rows = packed.collect()
    seqs = collections.defaultdict(list)
    whole = collections.defaultdict(list)
    for r in rows:
        ids = truth[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(ids) and r.ids_crc32 == crc(ids) and r.doc_tokens == len(truth[r.doc_id])
        seqs[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id].append((r.start, r.length))
    for pieces in (*seqs.values(), *whole.values()):
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
    assert {d: sum(n for _, n in p) for d, p in whole.items()} == {d: len(t) for d, t in truth.items()}
    assert max(sum(n for _, n in p) for p in seqs.values()) <= 2048
    x = packing.padding(packed).first()
    assert x.padded < 0.05 * x.ids


def test_plan_holds_demand_and_price_is_best():
    rng = np.random.default_rng(1)
    for _ in range(10):
        w = np.sort(rng.choice(np.arange(1, 30), 5, replace=False))
        v = rng.random(5)
        best, counts = packing.price(v, w, 40)
        table = [0.0] * 41
        for c in range(1, 41):
            table[c] = max([table[c - 1]] + [table[c - a] + b for a, b in zip(w.tolist(), v.tolist(), strict=True) if a <= c])
        assert abs(best - table[40]) < 1e-9 and (counts * w).sum() <= 40
        demand = dict(zip(w.tolist(), rng.integers(1, 500, 5).tolist(), strict=True))
        got = collections.Counter()
        for times, kinds in packing.plan(demand, 40):
            assert sum(k * n for k, n in kinds) <= 40
            for k, n in kinds:
                got[k] += times * n
        assert got == demand
    assert packing.plan({}, 40) == []


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_separator_scan(docs, block):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) for r in docs.where("doc_id < 20 or doc_id between 100000 and 100009").collect()}
    got = separators.count_tokens(docs.where("doc_id < 20 or doc_id between 100000 and 100009"), block=block).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want


def test_scan_reports_open_tail(spark):
    ids = np.array([5, 6, 9, 9, 7, 8, 8], "<u2")
    flat = spark.createDataFrame([(0, i, bytearray(ids[2 * i : 2 * i + 2].tobytes())) for i in range(4)], "file int, block long, ids binary")
    got = sorted((r.ordinal, r.n_tokens, r.closed) for r in separators.scan(flat, 9).collect())
    assert got == [(0, 2, True), (1, 0, True), (2, 3, False)]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_rules(docs):
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    for r in docs.collect():
        t = r.text or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen = collections.Counter(grams)
        cover = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert x.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (x.base_failed and x.kept)


def test_rule_order_changes_nothing(docs):
    m = rules.measured(docs)
    r = rules.default_rules()
    a, b = (m.select("doc_id", rules.cascade([(k, r[k], 0, 1) for k in ks]).isNull().alias("ok")) for ks in (list(r), list(r)[::-1]))
    assert sorted(a.collect()) == sorted(b.collect())


def test_rules_on_no_rows(docs):
    assert rules.judge(docs.where("false")).count() == 0


@pytest.fixture(scope="module")
def labelled():
    c = duckdb.connect()
    return c.execute("select doc_id, text, lang, quality, toxic from read_parquet('/root/testdata/sf0.1/documents.parquet') d join read_parquet('/root/testdata/sf0.1/labels.parquet') l using (doc_id) order by doc_id").fetchall()


def test_quality_held_out(labelled):
    fold = np.array([zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in labelled])
    x, y = qda.statistics(pa.array([r[1] for r in labelled])), np.array([r[3] for r in labelled])
    model = qda.train(x[~fold], y[~fold])
    assert ((model.scores(x[fold]) >= 0.5) == y[fold]).mean() > 0.97
    odd = model.scores(qda.statistics(pa.array(ODD)))
    assert ((odd >= 0) & (odd <= 1)).all()
    assert (qda.train(x[:0], y[:0]).scores(x[:3]) == 0.5).all()


def test_toxicity_held_out(labelled):
    rows = labelled[:2500]
    fold = np.array([zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows])
    train, held = [r for r, k in zip(rows, fold, strict=True) if not k], [r for r, k in zip(rows, fold, strict=True) if k]
    model = toxicity.fit([r[1] for r in train], [r[4] for r in train])
    p, y = model.scores(pa.array([r[1] for r in held])), np.array([r[4] for r in held])
    assert ((p >= 0.5) == y).mean() > 0.92 and (p[y == 0] >= 0.5).mean() < 0.03
    odd = model.scores(pa.array(ODD))
    assert ((odd >= 0) & (odd <= 1)).all()


def test_toxicity_dictionaries_keep_what_was_trained():
    rng = np.random.default_rng(5)
    words = [[f"{c}{i:05d}" for i in range(20_000)] for c in "ot"]
    texts = [" ".join(words[i % 4 == 0][k] for k in rng.integers(0, 20_000, 200)) for i in range(800)]
    model = toxicity.fit(texts, [int(i % 4 == 0) for i in range(800)])
    for held in (model.ordinary, model.toxic):
        assert held.startswith(b"\x37\xa4\x30\xec") and len(held) <= toxicity.DICTIONARY  # the trainer's mark
    assert b" o0" not in model.toxic and b" t0" not in model.ordinary


def test_language(spark, docs):
    names, table = langmix.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in langmix.predict(docs, names, table).collect()}
    known = [r for r in docs.collect() if r.lang and len(r.text) > 60]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in known]) > 0.98
    for i in (0, 1, 2):
        assert got[100_000 + i].lang_pred == "und" and got[100_000 + i].score == 0
    mixed = langmix.infer(pa.array([" ".join(r.text for r in known if r.lang == a)[:2000] + " " + " ".join(r.text for r in known if r.lang == b)[:2000] for a, b in (("en", "de"),)]), table)
    assert {names[j] for j in np.flatnonzero(mixed[1][0])} == {"en", "de"}


def test_queries_are_named():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 14))


def test_language_does_not_depend_on_neighbours():
    table = np.log(np.random.default_rng(0).random((3, 1 << langmix.BITS))).astype(np.float32)
    alone = langmix.infer(pa.array(["das ist ein haus"]), table)[0][0]
    for texts, i in ((["das ist ein haus", "  zz", "q"], 0), (["", "xx yy", "das ist ein haus"], 2), (["a", "das ist ein haus", ""], 1)):
        assert (langmix.infer(pa.array(texts), table)[0][i] == alone).all()


def test_quality_statistics_against_brute_force():
    texts = [t or "" for t in ODD] + ["One one ONE two.\nTwo | 33 AB ABc", "a b a b c"]
    got = qda.statistics(pa.array(texts))
    for t, row in zip(texts, got, strict=True):
        raw = t.encode()
        w = [x for x in re.split(rb"[\x09-\x0D ]+", raw) if x]
        n, count = max(1, len(raw)), max(1, len(w))
        angle = lambda x: float(np.arcsin(np.sqrt(x)))
        pairs = list(zip(w, w[1:], strict=False))
        want = {
            "bytes": np.log1p(len(raw)),
            "words": np.log1p(len(w)),
            "upper": angle(sum(65 <= c <= 90 for c in raw) / n),
            "digits": angle(sum(48 <= c <= 57 for c in raw) / n),
            "bars": angle(raw.count(b"|") / n),
            "lines": angle(raw.count(b"\n") / n),
            "word_bytes": np.log1p(sum(map(len, w)) / count),
            "short_words": angle(sum(len(x) <= 3 for x in w) / count),
            "distinct_words": np.log1p(len(set(w))) - 0.8 * np.log1p(len(w)),
            "top_word": angle(max(collections.Counter(w).values(), default=0) / count),
            "same_as_before": angle(sum(a == b for a, b in pairs) / count),
            "repeated_pairs": angle(1 - len(set(pairs)) / len(pairs)) if pairs else 0.0,
        }
        for name, x in want.items():
            assert abs(row[qda.NAMES.index(name)] - x) < 1e-9, (name, t[:40])


def test_quality_scores_are_log_density_differences():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(400, 4)), np.arange(400) % 2
    x[y == 1] = x[y == 1] * 1.7 + 0.6
    m = qda.Discriminant(x, y, 0.3, 0.1)
    z = (x - x.mean(0)) / x.std(0)
    pooled = sum(np.cov(z[y == c].T, bias=True) * (y == c).sum() for c in (0, 1)) / (len(z) - 2)
    density = []
    for c in (0, 1):
        s = 0.7 * np.cov(z[y == c].T) + 0.3 * pooled
        s = 0.9 * s + 0.1 * np.eye(4) * np.trace(s) / 4 + 1e-6 * np.eye(4)
        d = z - z[y == c].mean(0)
        density.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(m.margin(x), density[1] - density[0])


def test_toxicity_distances_against_one_word_at_a_time():
    model = toxicity.fit(["good day to all", "bad scum here"] * 60, [0, 1] * 60)
    ordinary, toxic = model._open()[:2]
    texts = ["Good scum day", "", None, "here here x"]
    got, first = model.distances(pa.array(texts))
    words = [w for t in texts for w in (t or "").lower().encode().split()]
    assert got.tolist() == [len(ordinary(toxicity.framed(w))) - len(toxic(toxicity.framed(w))) for w in words]
    assert first.tolist() == [0, 3, 3, 3, 6]


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables_and_null_ids(spark, tmp_path):
    """An empty table gives no rows; null ids, repeated ids and clashing columns do not crash."""
    for rows, name in (([], "none"), ([(None, "a text without id, long enough to be read", "en", "x", 1), (5, "one text", None, "x", 1), (5, "another text", "de", "x", 2), (6, None, "de", "x", 0)], "odd")):
        folder = tmp_path / name
        spark.createDataFrame(rows, EMPTY).withColumn("score", F.lit(1)).withColumn("y", F.lit(2)).withColumn("bucket", F.lit("z")).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0]], "doc_id long, quality int, toxic int").withColumn("text", F.lit("t")).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "x y")] if rows else [], "item_id long, text string").withColumn("doc_id", F.lit(9)).write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame([(1, None, None, None), (None, 1, "user", "a"), (1, None, None, None)] if rows else [], "conv_id long, turn long, role string, text string").withColumn("span", F.lit(3)).write.parquet(f"{folder}/conversations.parquet")
        for query, f in queries.QUERIES.items():
            got = f(spark, str(folder)).collect()
            named = 2 if query.startswith(("op10", "op12")) else {"op2_token_ids": 3, "op4_token_counts": 3, "op7_near_duplicates": 3}.get(query, 4)
            assert len(got) == (named if rows else 1 if query.startswith("op10") else 0), query
