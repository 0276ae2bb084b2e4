"""Exact dedup, sharding, packing, SentencePiece codec, token counts, quality and LM scores."""

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from conftest import SF_SMALL
from viewlens.llm import exact_dedup, lm_scoring, packing, quality, sentencepiece_codec, sharding, token_counts
from viewlens.llm import queries as Q
from viewlens.llm.common import WordMemo

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "a", "a  b\tc\n d", " x", "  x ", "▁x", "<|endoftext|> <s> <0x0A>", "é́ ﬁ①  　z",
       "it's we'll DON'T", "word\x1cword\x85word", "\U0001F600 z​", "a\0b", "x" * 30000, "the cat " * 3000,
       "Ünïcode, Straße! 12ab34 ***a***", "\n", "İstanbul ǅ", "ab́c,d"]


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet'").fetchall())


def test_word_memo_is_bounded_and_right():
    calls = Counter()

    def compute(w):
        calls[w] += 1
        return len(w)
    memo = WordMemo(compute, 10)
    for k in range(1000):
        assert memo["hot"] == 3 and memo["w" * (k % 50)] == k % 50
        assert len(memo) + len(memo.old) <= 20
    assert calls["hot"] == 1


# ------------------------------------------------------------------ exact dedup
def brute_groups(rows):
    by = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((i is None, i if i is not None else 0, k))
    out = {}
    for t, members in by.items():
        members.sort()
        keep = next((rows[m[2]][0] for m in members if not m[0]), None)
        for m in members:
            out[m[2]] = (rows[m[2]][0], keep, len(members), m == members[0], hashlib.sha256(t.encode()).hexdigest())
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("support", [1 / 4096, 1 / 8])
def test_exact_dedup_matches_brute_force(spark, support):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + k, "hot  text") for k in range(60)]
    rows += [(rng.randrange(400, 500), rng.choice(["p", "q ", "r\n"])) for _ in range(40)]
    rows += [(None, "only null"), (None, "only null"), (None, "p"), (7, "hot\ttext"), (7, "hot text")]
    rng.shuffle(rows)
    df = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    got = exact_dedup.with_copies(df, carry=("doc_id",), support=support)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_groups(rows)
    left = exact_dedup.drop_copies(df, support=support)
    assert left.columns == df.columns
    assert left.count() == len({r[4] for r in brute_groups(rows)})


def test_exact_dedup_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "y", 6)],
                               "doc_id long, text string, kept string, GROUP_SIZE long")
    got = exact_dedup.with_copies(df).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "a", "x", 5, 1, 2, True, got[0][-1]), (2, "a", "y", 6, 1, 2, False, got[0][-1])]
    assert exact_dedup.drop_copies(df).collect()[0]["kept"] == "x"
    assert exact_dedup.with_copies(df.limit(0)).count() == 0


def test_exact_dedup_main_path_is_native(spark):
    df = exact_dedup.with_copies(documents(spark, ["a", "b"]), carry=("doc_id",))
    assert "Python" not in df._jdf.queryExecution().toString()


# --------------------------------------------------------------------- sharding
def check_shards(rows, texts, n):
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((size(t), zlib.crc32((t or "").encode())) for t in texts)
    slots, total = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
        assert r.law == "bytes" and 0 <= r.shard < n and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    target = sum(total.values()) / n
    most = max(map(size, texts), default=0)
    assert all(abs(total[s] - target) <= most for s in range(n))


def test_shards_are_contiguous_and_even(spark, texts):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = sharding.shards(df, 8).collect()
    check_shards(rows, list(texts.values()), 8)
    in_order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in in_order] == sorted(texts)


def test_shards_of_odd_and_repeated_rows(spark):
    rows = [(1, "same")] * 500 + [(None, None), (None, "x"), (2, "")]
    got = sharding.shards(documents(spark, [t for _, t in rows], [i for i, _ in rows]), 8).collect()
    check_shards(got, [t for _, t in rows], 8)
    assert sharding.shards(documents(spark, []), 8).count() == 0
    assert [r.shard for r in sharding.shards(documents(spark, ["one"]), 8).collect()] == [4]


# ---------------------------------------------------------------------- packing
def test_word_tokens_equal_the_tokenizers_own(texts):
    from tokenizers import Tokenizer
    own, fast = Tokenizer.from_file(Q.WORD_BPE), packing.Tokens(Q.WORD_BPE)
    for t in [*ODD, *list(texts.values())[:80]]:
        ids = array("I", own.encode(t or "", add_special_tokens=False).ids)
        assert fast.encode(t or "") == ids.tobytes(), repr(t)[:80]


def test_best_fit_decreasing_against_a_scan():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = rng.integers(1, 65, rng.integers(0, 60))
        which, at, fill = packing.best_fit_decreasing(lengths, 64)
        bins = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [b for b in range(len(bins)) if bins[b] + n <= 64]
            if fits:
                bins[max(fits, key=bins.__getitem__)] += n
            else:
                bins.append(n)
        assert sorted(bins) == sorted(fill.tolist())
        for b in range(len(fill)):
            inside = sorted((int(at[k]), int(lengths[k])) for k in np.flatnonzero(which == b))
            end = 0
            for start, n in inside:
                assert start == end
                end += n
            assert end == fill[b] <= 64


@pytest.mark.parametrize("group_rows", [50_000, 40])
def test_packing_keeps_every_token_once(spark, texts, group_rows):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(Q.WORD_BPE)
    rows = [(i, t) for i, t in texts.items()] + [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "n"), (5, "again")]
    df = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    got = packing.packed(packing.pieces(df, Q.WORD_BPE, with_ids=True), group_rows=group_rows).collect()
    want = Counter()
    for i, t in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want[i, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(array("I", ids[k:k + 2048]).tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(array("I", r.ids).tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
    for members in sequences.values():
        end = 0
        for start, n in sorted(members):
            assert start == end
            end += n
        assert end <= 2048
    bound = -(-sum(r.length for r in got) // 2048)
    assert len(sequences) <= bound * 1.02 + 3
    assert packing.packed(packing.pieces(df.limit(0), Q.WORD_BPE)).count() == 0


# ---------------------------------------------------------- SentencePiece codec
def test_codec_equals_the_library(spark, texts):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=Q.PIECE_BPE)
    rows = [(i, t) for i, t in texts.items()] + [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "n"), (5, "again")]
    df = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    want = Counter()
    for i, t in rows:
        ids = sp.encode(t or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), sp.decode(ids))]
        want[i, len(ids), *sha] += 1
    assert Counter(map(tuple, sentencepiece_codec.digests(df, Q.PIECE_BPE).collect())) == want
    full = sentencepiece_codec.encoded(df.where("doc_id >= 1000"), Q.PIECE_BPE).collect()
    for r in full:
        t = ODD[r.doc_id - 1000] or ""
        assert r.ids == sp.encode(t) and r.decoded == sp.decode(sp.encode(t))
    assert sentencepiece_codec.digests(df.limit(0), Q.PIECE_BPE).count() == 0


# ----------------------------------------------------------------- token counts
def brute_segment(word, log_p):
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        s, c = best[end - 1][0] + n * token_counts.BYTE_LOG_P, best[end - 1][1] + n
        for start in range(end):
            p = log_p.get(word[start:end])
            if p is not None and (best[start][0] + p, -best[start][1] - 1) > (s, -c):
                s, c = best[start][0] + p, best[start][1] + 1
        best[end] = (s, c)
    return best[-1]


def test_trie_counts_equal_a_plain_viterbi():
    rng = random.Random(2)
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "aab", "bb", "abab", "▁ab"]
    log_p = token_counts.unigram_log_p(pieces)
    trie = token_counts.UnigramTrie(log_p, nodes=50)  # starts anew now and then
    for _ in range(500):
        w = "▁" + "".join(rng.choice("abé") for _ in range(rng.randrange(0, 12)))
        s, n = brute_segment(w, log_p)
        got = trie.insert(w)
        assert got[0] == n and math.isclose(got[1], s)
    long = "▁" + "ab" * 300
    s, n = brute_segment(long, log_p)
    assert trie.insert(long)[0] == n


def test_token_counts_of_documents(spark, texts):
    df = documents(spark, [*ODD, None], [*range(len(ODD)), None])
    got = {r.doc_id: r for r in token_counts.token_counts(df, Q.PIECE_BPE).collect()}
    _, trie = token_counts.tables(Q.PIECE_BPE)
    for i, t in enumerate(ODD):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert got[i].n_pretokens == len(words)
        short = [w for w in words if len(w) < 100]
        if len(short) == len(words) and len(words) < 50:
            assert got[i].n_tokens == sum(brute_segment("▁" + w, trie.log_p)[1] for w in words)
    assert got[None].n_tokens == 0 and got[0].log_p == 0
    assert token_counts.token_counts(df.limit(0), Q.PIECE_BPE).count() == 0


# ------------------------------------------------------------- quality classifier
def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = quality.best_labels(labels.where("doc_id % 3 != 0"))
    got = {r.doc_id: r for r in quality.scores(docs, train).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id].kept, r.quality) for r in labels.where("doc_id % 3 = 0").collect()]
    good = [k for k, q in held if q == 1]
    bad = [k for k, q in held if q == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)
    left = quality.good_documents(docs, train)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.select("doc_id").collect()} == {i for i, r in got.items() if r.kept}


def test_site_posteriors_against_plain_arithmetic(spark):
    rng = random.Random(4)
    rows = [(k, h, p, rng.uniform(-3, 3)) for k, (h, p) in enumerate(
        (f"h{rng.randrange(6)}", rng.choice(["x", "y", None])) for _ in range(300))]
    rows += [(1000, None, "x", 0.5)]
    labels = [(k, int(rng.random() < 0.2 + 0.1 * int(h[1]))) for k, h, p, _ in rows if h and k % 2]
    scored = spark.createDataFrame(rows, "doc_id long, host string, path string, doc_log_odds double")
    got = quality.site_posteriors(scored, spark.createDataFrame(labels, "id long, good int")).collect()
    marks, n, g = dict(labels), Counter(), Counter()
    for k, h, p, x in rows:
        w = 1.0 if k in marks else quality.SOFT_WEIGHT
        n[h, p] += w
        g[h, p] += w * (marks[k] if k in marks else 1 / (1 + math.exp(-x)))
    hn, hg = Counter(), Counter()
    for (h, _), v in n.items():
        hn[h] += v
    for (h, _), v in g.items():
        hg[h] += v
    total, rate = sum(hn.values()), sum(hg.values()) / sum(hn.values())

    def strength(squares, freedom, w, w2):
        spread = (squares - freedom * rate * (1 - rate)) / max(w - w2 / w, 1e-9)
        return min(max(rate * (1 - rate) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
    a = strength(sum(hn[h] * (hg[h] / hn[h] - rate) ** 2 for h in hn), len(hn) - 1, total, sum(v * v for v in hn.values()))
    host = {h: (hg[h] + a * rate) / (hn[h] + a) for h in hn}
    kids = Counter(h for h, _ in n)
    b = strength(sum(v * (g[k] / v - hg[k[0]] / hn[k[0]]) ** 2 for k, v in n.items()), sum(c - 1 for c in kids.values()),
                 total, total * sum(sum(v * v for k, v in n.items() if k[0] == h) / hn[h] for h in hn))
    assert len(got) == len(n)
    for r in got:
        k = (r.host, r.path)
        assert math.isclose(r.host_rate, host[r.host], rel_tol=1e-9)
        assert math.isclose(r.path_rate, (g[k] + b * host[r.host]) / (n[k] + b), rel_tol=1e-9)


def test_quality_without_evidence_keeps_everything(spark):
    docs = documents(spark, [*ODD, "a", "a"], [*range(len(ODD)), None, 3])
    none = quality.best_labels(spark.createDataFrame([(1, None), (None, 1), (99, 0)], "doc_id long, quality int"))
    got = quality.scores(docs, none).collect()
    assert len(got) == len(ODD) + 2 and all(r.kept for r in got)
    assert quality.good_documents(docs, none).count() == len(ODD) + 2
    assert quality.scores(docs.limit(0), none).count() == 0


# -------------------------------------------------------------------- LM scores
def brute_lm(rows, targets, model):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    size = sp.get_piece_size() + 1
    ids = [sp.encode(t or "") for _, t in rows]
    marks = [i in targets for i, _ in rows]

    def counts(use):
        uni, ctx, bi = Counter(), Counter(), Counter()
        for x, u in zip(ids, use):
            for a, b in zip([size - 1, *x], x) if u else ():
                uni[b] += 1
                ctx[a] += 1
                bi[a, b] += 1
        return uni, ctx, bi
    all_, target = counts([True] * len(rows)), counts(marks)
    out = []
    for (i, _), x, u in zip(rows, ids, marks):
        pairs = list(zip([size - 1, *x], x))
        losses = []
        for (uni, ctx, bi), mine in ((target, u), (all_, True)):
            own_u, own_c, own_b = (Counter(k) if mine else Counter() for k in (x, [a for a, _ in pairs], pairs))
            total = sum(uni.values()) - (len(x) if mine else 0)
            loss = 0.0
            for a, b in pairs:
                p = (uni[b] - own_u[b] + lm_scoring.UNIGRAM_PRIOR / size) / (total + lm_scoring.UNIGRAM_PRIOR)
                loss -= math.log((bi[a, b] - own_b[a, b] + lm_scoring.BIGRAM_PRIOR * p)
                                 / (ctx[a] - own_c[a] + lm_scoring.BIGRAM_PRIOR))
            losses.append(loss / len(x) if x else None)
        out.append((i, len(x), *losses))
    return out


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_lm_scores_equal_a_plain_model(spark, texts, monkeypatch, block):
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", block)
    rows = [(i, t[:600]) for i, t in list(texts.items())[:40]] + [(100, ""), (101, None), (None, "x y"), (3, "x y z")]
    df = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    targets = spark.createDataFrame([(i,) for i in (0, 3, 3, 7, 12, 999)], "doc_id long")
    got = sorted(map(tuple, lm_scoring.scores(df, targets, Q.PIECE_BPE).collect()), key=str)
    want = sorted(brute_lm(rows, {0, 3, 7, 12}, Q.PIECE_BPE), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2]
        if w[1]:
            assert math.isclose(g[2], w[2], rel_tol=1e-9) and math.isclose(g[3], w[3], rel_tol=1e-9)
            assert math.isclose(g[4], w[2] - w[3], abs_tol=1e-9)
        else:
            assert g[2:] == (None, None, None)


def test_lm_scores_without_targets_and_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long")
    df = documents(spark, ["a b c", "a b d"])
    assert all(r.score is not None for r in lm_scoring.scores(df, none, Q.PIECE_BPE).collect())
    assert lm_scoring.scores(df.limit(0), none, Q.PIECE_BPE).count() == 0


def test_batches_are_bounded_and_smaller_bounds_kept(spark):
    from viewlens.llm.common import BATCH_BYTES, importable
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    try:
        for value, want in (("64m", str(BATCH_BYTES)), ("2m", "2m"), ("1000", "1000"), ("67108864b", str(BATCH_BYTES))):
            spark.conf.set(name, value)
            importable(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, old)


def test_labels_of_one_kind_reject_nothing(spark):
    """All labels are good and name documents of host A; host B has none."""
    docs = spark.createDataFrame([(k, f"text number {k} of many", "A" if k < 100 else "B", "en") for k in range(500)],
                                 "doc_id long, text string, source string, lang string")
    for good in (1, 0):
        labels = spark.createDataFrame([(k, good) for k in range(100)], "id long, good int")
        assert {(r.score, r.kept) for r in quality.scores(docs, labels).collect()} == {(0.5, True)}
        assert quality.good_documents(docs, labels).count() == 500
