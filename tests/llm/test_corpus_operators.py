"""Every operator against plain code on a small fixture with nulls, ties, repeats, odd and very long texts."""

import re
import zlib
from collections import Counter, defaultdict
from math import ceil

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docweave.llm import op2_toxicity, op3_packing, op10_fingerprint
from docweave.llm.components import connected_components
from docweave.llm.gru import GruShape, Net, around, pooled, segments
from docweave.llm.op1_langid import code_matrix, identify
from docweave.llm.op2_toxicity import toxicity
from docweave.llm.op3_packing import PackSettings, cut, pack
from docweave.llm.op4_quality import keep_good, quality_rules, repeated_words
from docweave.llm.op5_warc import derivatives, responses, serialized
from docweave.llm.op6_minhash import MinMaxSettings, keep_one, near_duplicates, parity_map, shingle_set
from docweave.llm.op7_mixing import MixSettings, mix_documents, mixing_plan
from docweave.llm.op8_linededup import LineSettings, deduplicate
from docweave.llm.op9_sharding import hilbert_index, hilbert_shards, write_shards
from docweave.llm.op10_fingerprint import fingerprints, likeness

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


# ------------------------------------------------------------------ 1 language


def test_codes_are_apart():
    for n in (2, 3, 4, 7, 12):
        m = code_matrix(n, 1)
        assert len({tuple(r) for r in m}) == n
        assert not (np.abs(m.sum(0)) == n).any()


def test_languages(docs, rows):
    got = identify(docs).toPandas()
    assert len(got) == len(rows)
    truth = {d: lang for d, t, lang, _, _ in rows if d is not None and d < 90}
    held = [r for r in got.itertuples() if r.doc_id in truth and r.held_out]
    assert held and all(r.held_out == (crc(int(r.doc_id)) % 4 == 2) for r in got.itertuples() if r.doc_id == r.doc_id)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.9
    und = {int(r.doc_id) for r in got.itertuples() if r.lang_pred == "und"}
    assert {120, 121, 122, 124, 140} <= und
    assert got.score.between(0, 1).all()


def test_language_without_anything(empty, docs):
    assert identify(empty).count() == 0
    none = identify(docs.withColumn("lang", F.lit(None).cast("string"))).toPandas()
    assert set(none.lang_pred) == {"und"}


# ------------------------------------------------------------------ 2 toxicity


def test_every_window_is_scored():
    """Pooling gives each window of a text its own softmax mean, one word apart."""
    shape, rng = GruShape(), np.random.default_rng(1)
    for n in (1, 2, 15, 16, 17, 47, 48, 49, 130):
        score, value = rng.normal(0, 3, n), rng.normal(size=n)
        want = [np.average(value[i : i + shape.window], weights=np.exp(score[i : i + shape.window])) for i in range(max(n - shape.window + 1, 1))]
        assert np.allclose(pooled(score, value, shape.window), want)
        ids = np.arange(n)
        rows = segments(ids, -1, shape)
        assert rows[:, shape.warm : -shape.warm].ravel()[:n].tolist() == ids.tolist()
        for row, start in zip(rows, range(0, n, shape.core)):
            assert row.tolist() == [i if 0 <= i < n else -1 for i in range(start - shape.warm, start + shape.core + shape.warm)]
        for start in (0, max(n - shape.window, 0)):
            assert around(ids, start, -1, shape).tolist() == [i if 0 <= i < n else -1 for i in range(start - shape.warm, start + shape.window + shape.warm)]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = Net(GruShape(bits=4, word_dim=2, char_dim=2, hidden=3, attend=2))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.normal(size=(3, 5, 4)), np.array([1.0, 0.0, 1.0])
    mask = np.ones((3, 5))
    mask[1, 3:] = 0
    inside = mask.copy()
    inside[:, 0] = 0
    weight = np.array([1.0, 0.5, 2.0])
    g, dx, _ = net.gradients(x, mask, inside, y, weight)
    for name in ("Wx_f", "U_b", "U_f", "Wa", "v", "w", "bx_b", "b"):
        p = net.p[name]
        at = tuple(rng.integers(0, n) for n in p.shape)
        old = p[at]
        p[at] = old + 1e-4
        up = net.gradients(x, mask, inside, y, weight)[2]
        p[at] = old - 1e-4
        down = net.gradients(x, mask, inside, y, weight)[2]
        p[at] = old
        assert abs((up - down) / 2e-4 - g[name][at]) < 2e-3 + 0.02 * abs(g[name][at]), name


def test_toxic_windows(spark, empty, labels):
    import random

    rng = random.Random(2)
    rows, marks = [], []
    for i in range(240):
        words = [rng.choice(["ta", "re", "mi", "so", "la"]) + rng.choice(["na", "to", "ru"]) for _ in range(rng.randrange(20, 90))]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = "grobb" + rng.choice(["", "ta", "mi", "ru"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (None, "ta na"), (900, None), (901, "")], "doc_id long, text string")
    truth = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity(docs, truth).toPandas().set_index("doc_id")
    assert len(got) == 243 and got.score.between(0, 1).all()
    held = [(got.score[i], y) for i, y in marks if got.held_out[i]]
    good, bad = [s for s, y in held if not y], [s for s, y in held if y]
    assert np.mean([b > g for b in bad for g in good]) > 0.95
    assert np.mean(np.array(good) < 0.7) > 0.95
    assert got.score[900] == got.score[901] == 0
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert toxicity(empty, labels).count() == 0
    assert set(toxicity(docs, truth.where("toxic = 0")).toPandas().score) == {0.0}


def test_one_long_text_scores_like_any(rows):
    net = Net(GruShape())
    texts = [r[1] for r in rows if r[1]]
    ids, vocab = op2_toxicity.numbered(texts, net.shape.bits)
    gates = net.gates(vocab.vectors(net.words, net.chars))
    together = op2_toxicity.score_windows(net, gates, ids, 64)
    for t, z in list(zip(texts, together, strict=True))[-3:]:
        alone_ids, alone = op2_toxicity.numbered([t], net.shape.bits)
        again = op2_toxicity.score_windows(net, net.gates(alone.vectors(net.words, net.chars)), alone_ids, 4096)[0]
        assert np.allclose(z, again, atol=1e-5)


# ------------------------------------------------------------------ 3 packing


def test_cuts():
    for n in [*range(1, 3000), 5000, 123_457]:
        parts = cut(n, 2048, 8)
        assert sum(parts) == n and all(0 < p <= 2048 for p in parts)
        assert len(parts) <= n // 2048 + 6


def test_packing_holds_every_token_once(docs, rows, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    got = pack(docs, PackSettings(TOKENIZER)).toPandas()
    ids = defaultdict(list)
    for d, t, *_ in rows:
        ids[d].append(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    for d, parts in got.groupby("doc_id", dropna=False):
        mine = ids[None if d != d else int(d)]
        parts = parts.sort_values("start")
        assert parts.length.sum() == sum(map(len, mine))
        for p in parts.itertuples():
            assert p.doc_tokens == len(mine[0])
            assert p.ids_crc32 == zlib.crc32(mine[0][p.start : p.start + p.length].tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    assert 1 - got.length.sum() / (got.sequence_id.nunique() * 2048) < 0.1
    assert pack(empty, PackSettings(TOKENIZER)).count() == 0


def test_cached_tokens_are_the_tokenizers(rows):
    import random

    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(TOKENIZER), random.Random(3)
    letters = " \t\n　 \x1c\x1f\x85 aAbß́'sİıﬁ​12３,.!<|endoftext|>中\U0001f600Å"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(500)]
    texts += [r[1] for r in rows] + ["<|endoftext|>", "a<|startoftext|>b<|endoftext|> c"]
    for most in (1_000_000, 5):
        cached = op3_packing.WordTokenizer(TOKENIZER, most)
        for at in range(0, len(texts), 100):
            part = texts[at : at + 100]
            for t, got in zip(part, cached.encode(part), strict=True):
                assert got.tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_known_runs_are_not_tokenised_again():
    """A word that comes with other marks and capitals costs the tokenizer nothing; its ids stay the tokenizer's."""
    from tokenizers import Tokenizer

    class Asked:
        def __init__(self, inner):
            self.inner, self.texts = inner, []

        def encode_batch_fast(self, texts, **more):
            self.texts += texts
            return self.inner.encode_batch_fast(texts, **more)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    plain, cached = Tokenizer.from_file(TOKENIZER), op3_packing.WordTokenizer(TOKENIZER, 1000)
    cached.inner = asked = Asked(cached.inner)
    parts = [["erlyenq Erlyenq, (erlyenq)", "", "ERLYENQ!! It's 3x"], ["--Erlyenq-- \u00d6keitlichq.", "\x1cerlyenq"], ["\u00f6keitlichq ERLYENQ", " \x1c "]]
    for part in parts:
        for t, got in zip(part, cached.encode(part), strict=True):
            assert got.tolist() == plain.encode(t, add_special_tokens=False).ids
    said = " ".join(asked.texts).lower().replace("\x1cerlyenq", "")
    assert said.count("erlyenq") == 1 and said.count("\u00f6keitlichq") == 1


# ------------------------------------------------------------------ 4 quality


def plain_quality(t):
    words = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), failed


def test_quality_counts(docs, rows, labels, empty, clashing):
    got = quality_rules(docs, labels).toPandas()
    want = sorted((-1 if d is None else d, *plain_quality(t)) for d, t, *_ in rows)
    have = sorted((-1 if r.doc_id != r.doc_id else int(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.itertuples())
    assert have == want
    assert not got[got.base_failed].kept.any() and got.probability.between(0, 1).all()
    assert quality_rules(empty, labels).count() == 0
    left = keep_good(clashing, labels)
    assert left.columns == clashing.columns and left.count() == got.kept.sum()
    alone = quality_rules(docs, labels.limit(0)).toPandas()
    assert (alone.kept == ~alone.base_failed).all()


def test_repeated_words_with_many_words():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 5, 300)
    grams = Counter(zip(ids, ids[1:], ids[2:]))
    hit = {j for i in range(298) if grams[tuple(ids[i : i + 3])] > 1 for j in range(i, i + 3)}
    assert repeated_words(ids, 5) == repeated_words(ids, 1 << 22) == len(hit)


# ------------------------------------------------------------------ 5 WARC


def test_records_read_back(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.example/x", "<html><title> A &amp;\nB</title><script>x<y</script><p>One</p><!-- no --><p>Two <b>bold</b> é</p><a href='/l'>link</a><a href=\"/l\">again</a></html>"),
            (2, None, None),
            (None, "http://b.example", ""),
            (1, "http://a.example/x", "<p>other</p>"),
        ],
        "page_id long, url string, html string",
    )
    resp = responses(pages)
    made = derivatives(resp)
    assert made.count() == 8
    by = made.toPandas()
    assert set(by.refers_to) == set(resp.toPandas().record_id) and by.record_id.is_unique
    blob = b"".join(bytes(r[0]) for r in serialized(made).select("record").collect())
    found = []
    while blob:
        head, _, rest = blob.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        found.append((fields, rest[:n]))
        assert rest[n : n + 4] == b"\r\n\r\n"
        blob = rest[n + 4 :]
    import hashlib

    assert len(found) == 8
    for fields, block in found:
        assert fields[b"WARC-Block-Digest"] == b"sha1:" + hashlib.sha1(block).hexdigest().encode()
        assert fields[b"WARC-Refers-To"] in {x.encode() for x in by.refers_to}
    texts = by[by.record_type == "conversion"].block.tolist()
    assert "A & B\nOne\nTwo bold é\nlinkagain" in texts
    assert by[by.record_type == "metadata"].n_outlinks.max() == 1
    assert derivatives(responses(pages.limit(0))).count() == 0


# ------------------------------------------------------------------ 6 near copies


def plain_sets(rows, k):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for d, t, *_ in rows:
        w = WORD.findall((t or "").translate(low))
        out.append((d, set() if not w else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}))
    return out


def plain_components(sets):
    up = {d: d for d, _ in sets if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return root


@pytest.mark.parametrize("k", [2, 5])
def test_near_copies(docs, rows, k):
    got = near_duplicates(docs, MinMaxSettings(shingle=k)).toPandas()
    sets = plain_sets(rows, k)
    root = plain_components(sets)
    assert len(got) == len(rows)
    size = {d: len(s) for d, s in sets}
    for r in got.itertuples():
        if r.doc_id != r.doc_id:
            assert r.component_id != r.component_id and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (root(r.doc_id), size[r.doc_id], r.doc_id == root(r.doc_id))


def test_near_copies_of_nothing(empty, clashing):
    assert near_duplicates(empty).count() == 0
    left = keep_one(clashing)
    assert left.columns == clashing.columns and 0 < left.count() < clashing.count()


def test_chain_of_links(spark):
    """Each text is similar to the next one only; the chain is one component."""
    words = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join(words[i * 5 : i * 5 + 80])) for i in range(12)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), MinMaxSettings(shingle=2)).toPandas()
    assert set(got.component_id) == {0}


def test_parity_never_refuses():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, rng.integers(0, 40)).astype(np.uint64)]))
        bits = np.bitwise_count((parity_map(a) ^ parity_map(b)).view(np.uint64)).sum()
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components(spark):
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = list(range(200))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_shingle_set_is_one_for_short_texts():
    assert len(shingle_set("a b", 5)) == 1 and len(shingle_set(" ", 5)) == 0 and len(shingle_set(None, 2)) == 0


# ------------------------------------------------------------------ 7 mixing


def plain_targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        all_w = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / all_w > most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / all_w for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
        if not open_:
            return target


def test_mixing(docs, rows, empty, clashing):
    got = mixing_plan(docs).toPandas()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = plain_targets(sizes, (5, 2, 1), 3)
    for r in got.itertuples():
        s = r.source if isinstance(r.source, str) else None
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        rate = want[s] / sizes[s]
        assert r.copies in (int(rate), int(rate) + 1)
    again = mixing_plan(docs.repartition(7)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert got.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))
    assert mixing_plan(empty).count() == 0
    mixed = mix_documents(clashing)
    assert mixed.columns == clashing.columns and mixed.count() == got.copies.sum()
    assert {r[0] for r in mixed.select("copies").distinct().collect()} == {"own copies"}


def test_chance_is_even(spark):
    from docweave.llm.op7_mixing import chance

    got = spark.range(20_000).select(chance(F.col("id"), F.lit("s")).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(got[0] - 0.5) < 0.01 and got[1] >= 0 and got[2] < 1


def test_shares_are_met(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(9000)]
    got = mixing_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), MixSettings()).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t / r.g - 1) < 0.1 for r in got)  # four standard deviations of the rarest source's independent draws


# ------------------------------------------------------------------ 8 lines


def plain_removed(rows, percent=80):
    """By (doc_id, copy of the row): the line numbers that an earlier line matches; all pairs."""
    order = sorted((-1 << 70 if d is None else d, i) for i, (d, t, *_) in enumerate(rows) if t is not None)
    lines = [((n, i), set(WORD.findall(x))) for n, (_, at) in enumerate(order) for i, x in enumerate(rows[at][1].split("\n"))]
    gone = {n: [] for n in range(len(order))}
    for at, s in lines:
        if s and any(p < at and o and 100 * len(s & o) >= percent * len(s | o) for p, o in lines):
            gone[at[0]].append(at[1])
    return sorted(((rows[at][0], rows[at][1], gone[n]) for n, (_, at) in enumerate(order)), key=str)


@pytest.mark.parametrize("passes", [1, 3])
def test_lines(docs, rows, passes):
    got = deduplicate(docs, LineSettings(passes=passes)).collect()
    assert len(got) == len(rows)
    assert [(r.n_lines, list(r.removed), r.lines_left) for r in got if r.text is None] == [(0, [], 0)]
    want = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone), gone, t.count("\n") + 1) for d, t, gone in plain_removed(rows)]
    assert sorted(((r.doc_id, r.text, list(r.removed), r.n_lines) for r in got if r.text is not None), key=str) == sorted(want, key=str)
    assert all(r.lines_left == r.n_lines - len(r.removed) for r in got)


def test_lines_of_wide_ids_and_near_copies(spark):
    base = [f"t{i}" for i in range(40)]
    rows = []
    for i in range(60):
        words = list(base)
        for j in range(i % 9):
            words[(i * 7 + j * 5) % 40] = f"n{i}_{j}"
        rows.append(((i - 30) * (1 << 56), "head\n" + " ".join(words)))
    got = {r.doc_id: list(r.removed) for r in deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {d: gone for d, _, gone in plain_removed(rows)}


def test_lines_of_very_long_texts(spark):
    """Cutting is linear in a document's lines: half of 60,000 go."""
    rows = [(1, "\n".join(f"line {i} a{i} b{i} c{i}" for i in range(30_000))), (2, "\n".join(f"line {i} {'a' if i % 2 else 'z'}{i} {'b' if i % 2 else 'y'}{i} c{i}" for i in range(60_000)))]
    got = {r.doc_id: r for r in deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].removed == [] and got[2].removed == list(range(1, 30_000, 2))
    assert got[2].text.split("\n")[:2] == ["line 0 z0 y0 c0", "line 2 z2 y2 c2"]


def test_lines_of_nothing(empty, clashing):
    assert deduplicate(empty).count() == 0
    made = deduplicate(clashing)
    assert made.count() == clashing.count() and "digest" in made.columns and made.columns.count("removed") == 1


def test_lines_run_no_python(docs):
    plan = deduplicate(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ------------------------------------------------------------------ 9 shards


def test_hilbert_steps_by_one(spark):
    for n, bits in ((2, 3), (3, 2)):
        df = spark.range(1 << (n * bits))
        for i in range(n):
            df = df.withColumn(f"c{i}", F.shiftright("id", i * bits).bitwiseAND((1 << bits) - 1))
        rows = sorted(hilbert_index(df, [f"c{i}" for i in range(n)], bits, "h").collect(), key=lambda r: r.h)
        assert [r.h for r in rows] == list(range(1 << (n * bits)))
        for a, b in zip(rows, rows[1:]):
            assert sum(abs(a[f"c{i}"] - b[f"c{i}"]) for i in range(n)) == 1


def test_shards(spark, docs, rows, empty, clashing):
    got = hilbert_shards(docs, 12).toPandas()
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all() and len(got) == len(rows)
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    ordered = got.sort_values(["shard", "slot"])
    assert ordered.place.is_monotonic_increasing
    texts = Counter((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert texts == Counter(zip(got["size"].tolist(), got.text_crc32.tolist(), strict=True))
    assert got.groupby(["size", "text_crc32"]).shard.nunique().max() == 1
    # cuts lie at the nearest end of a group: no shard's end is further from its goal than half the largest group
    total, most = got["size"].sum(), got.groupby(["size", "text_crc32"])["size"].sum().max()
    ends = got.groupby("shard")["size"].sum().reindex(range(12), fill_value=0).cumsum()
    assert all(abs(e - total * (k + 1) // 12) <= most / 2 + 1 for k, e in ends.items())
    assert hilbert_shards(empty).count() == 0
    assert hilbert_shards(docs.limit(3), 40).toPandas().shard.nunique() == 3
    again = hilbert_shards(clashing.drop("pos"), 12).toPandas()
    key = ["shard", "slot", "size", "text_crc32", "place"]
    assert again.sort_values(key)[key].reset_index(drop=True).equals(got.sort_values(key)[key].reset_index(drop=True))


def test_a_hot_group_is_one_shards(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i}", "en", f"s{i % 5}") for i in range(600)]
    got = hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5), 10).toPandas()
    assert len(got) == 600 and got[got["size"] == 24].groupby("text_crc32").shard.nunique().max() == 1
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))


def test_written_shards_prune(spark, tmp_path):
    """Ids may be null or shared: every row is written once, with its columns, and filters meet few shards."""
    rows = [(None if i % 50 == 0 else i // 2, f"text {i} " * (1 + i % 40), f"l{i % 4}", f"s{i % 16:02}", "own") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string").repartition(4)
    write_shards(docs, str(tmp_path / "out"), 32)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 2000 and sorted(back.select("text").toPandas().text) == sorted(r[1] for r in rows)
    for column, most in (("source", 0.6), ("lang", 0.6)):
        spans = back.groupBy("shard").agg(F.min(column).alias("a"), F.max(column).alias("b")).collect()
        values = [r[0] for r in back.select(column).distinct().collect()]
        met = sum(r.a <= v <= r.b for r in spans for v in values) / len(spans) / len(values)
        assert len(spans) == 32 and met < most, (column, met)


# ------------------------------------------------------------------ 10 fingerprints


def plain_likeness(a, b):
    def common(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, e in enumerate(y):
                new.append(row[j] + 1 if c == e else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    if a == b:
        return 1.0
    (i, a1, a2), (j, b1, b2) = (x.split(":") for x in (a, b))
    i, j = int(i), int(j)
    pairs = [(a1, b1), (a2, b2)] if i == j else [(a2, b1)] if 2 * i == j else [(a1, b2)] if i == 2 * j else []
    return max([0.0, *(2 * common(x, y) / (len(x) + len(y)) for x, y in pairs if x or y)])


@pytest.mark.parametrize("ranges", [None, 1, 9])
def test_fingerprints(docs, rows, ranges):
    got = fingerprints(docs, ranges).toPandas()
    order = sorted(((-(1 << 63) if d is None else d), t or "") for d, t, *_ in rows)
    order.sort(key=lambda r: (-r[0], r[1]))
    want = Counter()
    fp = op10_fingerprint.fingerprint
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        new = op10_fingerprint.edited(t, nxt)
        import hashlib

        want[(d, len(t), hashlib.sha256(new.encode()).hexdigest(), fp(t), fp(new), round(plain_likeness(fp(t), fp(new)), 9), round(plain_likeness(fp(t), fp(nxt)), 9))] += 1
    have = Counter(
        (-(1 << 63) if r.doc_id != r.doc_id else int(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got.itertuples()
    )
    assert have == want


def test_fingerprint_properties(empty, docs):
    assert fingerprints(empty).count() == 0
    one = fingerprints(docs.where("doc_id = 5")).toPandas()
    assert len(one) == 1 and one.near_next[0] == 1.0
    text = "".join(map(chr, np.random.default_rng(6).integers(97, 123, 20_000)))
    fp = op10_fingerprint.fingerprint
    assert len(fp(text)) < 150
    near = text[:9000] + "something else" + text[9000:]
    assert likeness([(fp(text), fp(near))])[0] > 0.8 > 0.5 > likeness([(fp(text), fp(text[::-1] * 3))])[0]


def test_needed_overlap_is_what_jaccard_asks():
    for n in range(5, 200):
        assert n - (80 * n + 99) // 100 + 1 == n - ceil(0.8 * n - 1e-9) + 1


# ------------------------------------------------------------------ samples


def test_samples_keep_every_key(spark):
    """Sixty languages, one of them with a document repeated 10,000 times and two texts under one id."""
    from docweave.llm.shared import labelled_sample

    rows = [(i, f"text {i}", f"l{i % 60}") for i in range(3000)] + [(7, "again and again", "l7")] * 10_000 + [(None, "x", "l1"), (9000, None, "l2"), (9001, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = labelled_sample(docs, "lang", 20, 300, 10**6)
    assert Counter(k for _, k in got) == {f"l{i}": 5 for i in range(60)}
    assert got == labelled_sample(docs.repartition(3), "lang", 20, 300, 10**6)
    assert {k for _, k in labelled_sample(docs, "lang", 20, 10, 10**6)} == {f"l{i}" for i in range(60)}
    marks = docs.select("doc_id", F.col("lang").alias("mark"))
    by_label = labelled_sample(docs.drop("lang"), "mark", 20, 300, 10**6, marks)
    assert sorted(by_label) == sorted(got) and "again and again" not in {t for t, _ in by_label}


def test_shards_run_no_python(docs):
    plan = hilbert_shards(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


def test_tables_go(spark, docs, labels):
    """Operators leave only what their lazy results read; a scope around them leaves nothing, on failure too."""
    from docweave.llm.shared import discarding, materialize, shared_folder

    def left():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/docweave")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return {str(f.getPath().getName()) for f in files.listStatus(path)} if files.exists(path) else set()

    before = left()
    with discarding(spark):
        deduplicate(docs).count()
        keep_one(docs).count()
        mix_documents(docs).count()
        hilbert_shards(docs, 5).count()
    assert left() == before
    with pytest.raises(ZeroDivisionError), discarding(spark) as keep:
        keep(materialize(docs, "kept"))
        raise ZeroDivisionError
    assert left() == before
    deduplicate(docs).count()
    assert len(left() - before) <= 2
