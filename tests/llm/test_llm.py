"""Training-data operators against brute force, on small fixtures with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import math
import pathlib
import random
import re
import threading
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tracewell.llm import bpe, covertree, induced, mixing, neardup, ngrams, passages, pii, quality, quoting, toxicity
from tracewell.llm.common import fold

DOCS = "doc_id long, text string, kept string"


def _docs(spark, texts):
    """With an extra column that has the name of a result."""
    return spark.createDataFrame([(i, t, "x") for i, t in texts], DOCS)


def test_cover_tree_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)] + [(500, None), (501, [None] + [1.0] * 7), (502, [float("nan")] * 8), (503, [1.0]), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for r in covertree.top_k(df, df.vec_id % 20 == 0, k=7, query_block=5, candidate_block=64).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if v and len(v) == 8 and None not in v and not np.isnan(v).any()}
    for q in (i for i in good if i % 20 == 0):
        best = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:7]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def _clustered(rng, n, dims=16, clusters=40):
    centres = rng.normal(size=(clusters, dims)) * 300
    return np.round(centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dims)) * 4).astype(np.int64)


def test_cover_tree_invariants():
    rng = np.random.default_rng(4)
    x = _clustered(rng, 3000).astype(float)
    t = covertree.CoverTree(x)
    assert any(t.children)
    for i, parts in enumerate(t.children):
        own = x[t.order[t.start[i] : t.stop[i]]]
        assert np.sqrt(((own - x[t.centre[i]]) ** 2).sum(1)).max() <= min(t.radius[i], 2.0 ** t.level[i] * (1 + 1e-9))
        if parts:
            reach, heads = 2.0 ** (t.level[i] - 1), x[[t.centre[c] for c in parts]]
            gaps = np.sqrt(((heads[:, None] - heads[None]) ** 2).sum(2)) + np.eye(len(heads)) * 1e9
            assert t.centre[i] in [t.centre[c] for c in parts] and gaps.min() > reach  # nested and separated
            assert all(t.radius[c] <= reach * (1 + 1e-6) + 1e-6 for c in parts)  # covering
            assert sorted((t.start[c], t.stop[c]) for c in parts)[0][0] == t.start[i]


def test_dual_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(5)
    x = _clustered(rng, 4000)
    q, ids, scored = x[::20], np.arange(4000), []
    best, names, found = covertree.search(q, ids[::20], x, ids, 10, count=scored)
    assert sum(scored) < 0.2 * len(q) * len(x)
    for r, i in enumerate(ids[::20]):
        want = sorted((-int(x[i] @ x[j]), j) for j in ids if j != i)[:10]
        assert [(-s, n) for s, n in zip(best[r].tolist(), names[r].tolist())] == want
    with pytest.raises(ValueError):
        covertree.product(np.full((1, 2), 1 << 40), np.full((1, 2), 1 << 40))


def test_index_drops_block_pairs(spark):
    rng = np.random.default_rng(6)
    x = _clustered(rng, 3000)
    df = spark.createDataFrame([(int(i), (v / 64).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    stats = {}
    got = covertree.top_k(df, df.vec_id % 20 == 0, k=5, query_block=64, candidate_block=64, sample=1000, parts=40, stats=stats).collect()
    assert stats["searched"] < 0.3 * stats["all"]
    rows = collections.defaultdict(list)
    for r in got:
        rows[r.query_id].append((r["rank"], r.vec_id, r.score))
    for i in range(0, 3000, 200):
        best = sorted((-int(x[i] @ x[j]), j) for j in range(3000) if j != i)[:5]
        assert sorted(rows[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert covertree.top_k(df.limit(0), df.vec_id % 20 == 0).count() == 0
    with pytest.raises(Exception, match="out of range"):
        covertree.top_k(spark.createDataFrame([(0, [1e300])], "vec_id long, embedding array<double>"), F.lit(True)).count()


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_bpe_equals_tiktoken(name):
    own = bpe.codec(public_tokenizers.path(name), public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(rng.choice(["abc", "the ing", "a  \n\t", "éèü漢字😀", "0123", "\x00\xff!?"])) for _ in range(rng.randint(0, 60)))
        ids = own.encode(text)
        assert ids == theirs.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
    long = "ab" * 30_000
    assert own.encode(long) == theirs.encode_ordinary(long)


def test_bpe_rows(spark):
    df = _docs(spark, [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x")])
    rows = bpe.digest_documents(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 1, 2, 2]
    assert bpe.digest_documents(df.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_toxicity_learns(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ing", "on"]) for _ in range(3))
    rows, labels = [], []
    for i in range(600):
        words, toxic = [word() for _ in range(60)], i % 3 == 0
        if toxic:
            words[5] = words[20] = words[40] = "grumblefusk"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = _docs(spark, [*rows, (1000, None), (1001, "")]), spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    out = toxicity.score_documents(docs.drop("kept"), toxicity.train(docs, marks)).collect()
    truth = dict(labels)
    held = [r for r in out if r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in toxicity.score_documents(docs, toxicity.train(docs, marks.limit(0)), names=("s", "p")).toDF("a", "b", "c", "score", "p").collect()} == {0.0}


def _quality_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    marked = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(len(re.findall(r"[#*$%&|<>]", w)) for w in words), len(lines) - len(set(lines)), len(marked)


def test_quality_counts():
    rng = random.Random(2)
    for text in [None, "", " \n ", "a a a a", "x\x1cy\x85z\xa0q " * 3] + ["".join(rng.choice("ab #é\n\t|") for _ in range(rng.randint(0, 120))) for _ in range(300)]:
        assert quality.counts_of(text)[0] == _quality_counts(text), repr(text)


def test_forest_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 2))
    y = ((x[:, 0] + 0.3 * rng.normal(size=2000)) < 0.5).astype(float)
    forest = quality.fit_forest(x, y, [-1, 0])
    for b in (0.1, 0.9):
        line = forest.margins(np.stack([np.linspace(0, 1, 200), np.full(200, b)], 1))
        assert (np.diff(line) <= 1e-9).all()
    assert ((forest.margins(x) > 0) == (y > 0)).mean() > 0.75


def test_quality_rows(spark):
    docs = _docs(spark, [(1, None), (2, " ".join(map(str, range(60)))), (2, "a"), (None, "b")])
    out = quality.judge(docs, quality.train(docs, spark.createDataFrame([], "doc_id long, quality int")), names={"kept": "stays"}).collect()
    assert sorted(r.stays for r in out) == [False, False, False, True]


def _components(texts, size, percent):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in texts:
        w = (t or "").encode().translate(low).split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("limit", [0, 1000])
def test_near_duplicates(spark, limit):
    rng = random.Random(4)
    base = [rng.choice("abcdefghij") + str(rng.randint(0, 300)) for _ in range(120)]
    texts = []
    for i in range(120):
        words = list(base) if i % 2 else [rng.choice("klm") + str(rng.randint(0, 99)) for _ in range(80)]
        for _ in range(rng.choice([0, 2, 4, 7, 12])):
            words[rng.randrange(len(words))] = f"n{rng.random()}"
        texts.append((i, " ".join(words)))
    texts += [(200, None), (201, ""), (202, "One"), (203, "one"), (204, texts[3][1]), (205, texts[3][1].upper())]
    out = neardup.components(_docs(spark, texts), size=2, broadcast_classes=limit).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == _components(texts, 2, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_deduplicate(spark):
    text = " ".join(map(str, range(40)))
    df = _docs(spark, [(1, text), (2, text), (2, text), (3, "z"), (3, "z"), (None, "q"), (4, None)])
    assert sorted(str(r.doc_id) for r in neardup.deduplicate(df).collect()) == ["1", "3", "4", "None"]
    words = [" ".join(f"{x}{i}" for i in range(60)) for x in "abc"]
    rows = [(7, words[0]), (7, words[1]), (3, words[1]), (7, words[0]), (7, words[0].upper()), (8, words[2]), (8, words[2] + " z"), (9, ""), (9, "")]
    got = neardup.deduplicate(_docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.text[:2]) for r in got) in ([(3, "b0"), (7, a), (8, "c0"), (9, ""), (9, "")] for a in ("A0", "a0"))
    assert neardup.deduplicate(df.limit(0)).count() == 0


def _luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(2 * x - 9 if x > 4 else 2 * x for x in d[1::2])) % 10 == 0


def _base_spans(x):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 16 <= sum(c.isdigit() for c in m.group()) <= 19 and _luhn(m.group())]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def test_personal_data_added_forms(spark):
    """Loose forms beside words that speak for them are found and redacted; those that context or gazetteer speak against are not."""
    rng = random.Random(2)
    base = [f"please mail me: user{i}@host{i}.com or call +49 30 1234{i:04d}, server 10.0.{i}.7" for i in range(60)] + [f"serial no. {i} version 999.{i}.300.4 build" for i in range(30)]
    loose = {
        "contact jane.doe at example dot org now": ("email", "jane.doe at example dot org"), "write to bob@corp[.]com": ("email", "bob@corp[.]com"),
        "call me: 212-555-0187": ("phone", "212-555-0187"), "tel: 0049 30 123 4567": ("phone", "0049 30 123 4567"), "login from 10[.]1[.]2[.]3": ("ip", "10[.]1[.]2[.]3"),
    }
    against = ["isbn 112-555-0187 order", "build 000-000-0000"]
    texts = [*base, *(t for t in loose for _ in range(6)), *(t for t in against for _ in range(6))]
    rng.shuffle(texts)
    df = _docs(spark, list(enumerate(texts)))
    added = {r.doc_id: [(pii.KINDS[x.k], texts[r.doc_id][x.s : x.e]) for x in r.added] for r in pii.find_spans(df.drop("kept")).collect()}
    for i, t in enumerate(texts):
        assert added[i] == ([loose[t]] if t in loose else []), t
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert all(clean[i] == t.replace(loose[t][1], f"[{loose[t][0].upper()}]") for i, t in enumerate(texts) if t in loose)
    assert pii.find_spans(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


def test_personal_data_in_long_texts_is_linear(spark):
    import time

    seconds = []
    for n in (500, 4000):
        text = " ".join(f"a{i}@b{i}.com" for i in range(n))
        df = _docs(spark, [(1, text)])
        began = time.time()
        assert pii.redact(df).first().text == " ".join(["[EMAIL]"] * n)
        seconds.append(time.time() - began)
    assert seconds[1] < seconds[0] + 20


def test_quoting_of_many_lines(spark):
    lines = [f"line number {i}" for i in range(4000)]
    quoted = [f"> line number {i}" if i % 2 else f"answer {i}" for i in range(4000)]
    df = spark.createDataFrame([(1, 0, "a", "\n".join(lines)), (1, 1, "b", "\n".join(quoted))], "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in quoting.link(df).collect()}
    assert got[1].parent_turn == 0 and got[1].n_quotes == 2000 and got[1].clean_text == "\n".join(x for x in quoted if x[0] != ">")


def test_personal_data_base_spans(spark):
    rng = random.Random(6)
    parts = ["a@b.co", "x.y@mail.example.com_z@q.r", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.02.3.4", "4111 1111-1111 1111", "4111111111111111", "411111111111111111112",
             "+1 (482) 555-7163", "+12", "é😀", " ", "\n", "12  34", "+1 2 3 4 5 6 7 8", "a@", "@b.c", "@", "7 ", "-", "%+"]
    texts = [(None, None), (0, "")] + [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))) for i in range(1, 400)] + [(900, "a." * 20_000 + "@x.y")]
    texts += [(901, "mail me at bob at example dot com or call 482 555 7163 now")]
    out = {r.doc_id: r for r in pii.find_spans(_docs(spark, texts).drop("kept")).collect()}
    for i, t in texts:
        got = [(pii.KINDS[x.k], x.s, x.e) for x in sorted(out[i].base)]
        assert sorted(got) == sorted(_base_spans(t or "")), repr(t)[:200]


def test_redaction_keeps_columns(spark):
    df = _docs(spark, [(1, "é a@b.co and +1 482 555 7163."), (2, None), (2, "plain")])
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted(str(r.text) for r in out.collect()) == ["None", "plain", "é [EMAIL] and [PHONE]."]


def test_expectation_maximisation():
    good, bad = (1, 1, 1), (0, -1, 0)
    post = pii.estimate([(0, good, 90), (0, bad, 60), (0, (0, 1, 1), 10)])
    assert post[0, good] > 0.9 > 0.5 > post[0, bad]


@pytest.mark.parametrize("size,hot", [(0, {}), (1 << 30, {}), (0, {"the": 4, "cat": 2}), (1 << 30, {"the": 4, "w1": 3})])
def test_ngram_scores(spark, monkeypatch, size, hot):
    if hot:
        monkeypatch.setattr(ngrams, "hot_words", lambda *_: {int(ngrams.word_hashes(w)[0]): n for w, n in hot.items()})
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice(["the", "The", "cat", "dog", "ran", "sat", f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(90, None), (91, "")]
    tokens = {i: [*(t or "").lower().split(), None] for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in texts}
    c, seen = collections.Counter(), [collections.Counter(), collections.Counter()]
    for i, w in tokens.items():
        if not held[i]:
            c.update(w)
            for k in (1, 2):
                seen[k - 1].update((("<s>",) * max(0, k - n) + tuple(w[max(0, n - k) : n]), w[n]) for n in range(len(w)))
    z = sum(c.values()) + 0.5 * (len(c) + 1)
    total, kinds = collections.Counter(), collections.Counter()
    for s in seen:
        for (ctx, _), n in s.items():
            total[ctx] += n
            kinds[ctx] += 1

    def p(ctx, x):
        lower = (c[x] + 0.5) / z if not ctx else p(ctx[1:], x)
        if not ctx or not total[ctx]:
            return lower
        return max(0.0, seen[len(ctx) - 1][ctx, x] - 0.75) / total[ctx] + 0.75 * kinds[ctx] / total[ctx] * lower

    for r in ngrams.score_documents(_docs(spark, texts), model_bytes=size, shard_chars=200).collect():
        w = tokens[r.doc_id]
        base = sum(math.log10((c[x] + 0.5) / z) for x in w)
        full = sum(math.log10(p((["<s>", "<s>", *w][n], ["<s>", "<s>", *w][n + 1]), x)) for n, x in enumerate(w))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c[x] > 0 for x in w), sum(c.values()))
        # each of the three factors of a token is within half a step
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base)) and abs(r.score - full) < 0.02 * len(w)


def test_ngram_empty_and_long(spark):
    assert ngrams.score_documents(_docs(spark, [(1, "a")]).limit(0)).count() == 0
    rows = ngrams.score_documents(_docs(spark, [(i, "a b " * (200_000 if i == 3 else 1)) for i in range(6)])).collect()
    assert sorted(r.n_tokens for r in rows)[-1] == 400_001 and all(r.score <= 0 for r in rows)


def test_ngram_blocks_are_small_and_equal_the_mapped_trie(spark, tmp_path, monkeypatch):
    """In blocks the texts' triples are on disk once: at no time more than five bytes a character of this corpus (14 when they were dealt twice as columns)."""
    rng = random.Random(5)
    vocab = [f"{rng.choice('abcdefg')}{i}w" for i in range(3000)]
    texts = [(i, " ".join(rng.choice(vocab[: rng.choice([20, 3000])]) for _ in range(400))) for i in range(800)] + [(None, "a b"), (900, None), (901, "")]
    docs = _docs(spark, texts).repartition(4, "doc_id").cache()
    docs.count()
    monkeypatch.setattr("tracewell.llm.common.shared_dir", lambda _: str(tmp_path))
    local = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: [p for d in (*local, tmp_path) for p in pathlib.Path(d).rglob("*")]
    before, most, stop = set(files()), [0], threading.Event()

    def size(p):
        try:
            return p.stat().st_size if p.is_file() else 0
        except FileNotFoundError:
            return 0

    def watch():
        while not stop.wait(0.05):
            most[0] = max(most[0], sum(size(p) for p in files() if p not in before))

    watching = threading.Thread(target=watch)
    watching.start()
    dealt = sorted(map(tuple, ngrams.score_documents(docs, model_bytes=0, shard_chars=200_000).collect()), key=str)
    stop.set()
    watching.join()
    assert 0 < most[0] < 5 * sum(len(t or "") for _, t in texts)
    assert dealt == sorted(map(tuple, ngrams.score_documents(docs, shard_chars=200_000).collect()), key=str)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1), (50, 60), (500, 1 << 40), (500, 1 << 20), (3000, 4000), (2000, 1 << 33)):
        values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        ef = ngrams.EliasFano.build(values, top)
        assert (ef.access(np.arange(len(values))) == values).all()
        assert (ef.find(values) == np.arange(len(values))).all()
        others = np.setdiff1d(rng.integers(0, top, 100, dtype=np.uint64), values)
        assert (ef.find(others) == -1).all()


@pytest.mark.parametrize("spill", [None, 64])
def test_induced_repeats(monkeypatch, spill):
    if spill:
        monkeypatch.setattr(induced, "QUEUE_BYTES", spill)
    rng = np.random.default_rng(2)
    for k in range(150 if spill else 600):
        n, symbols, depth = int(rng.integers(1, 60)), int(rng.integers(1, 5)), int(rng.integers(1, 8))
        t = rng.integers(1, 1 + symbols, n)
        t = np.r_[np.tile(t, 3)[:n] if k % 3 else t, 0].astype(np.uint16)
        seen = collections.Counter(tuple(t[i : i + depth]) for i in range(n + 2 - depth))
        want = [i + depth <= n + 1 and seen[tuple(t[i : i + depth])] > 1 for i in range(n + 1)]
        assert induced.repeats(t, depth).tolist() == want


def _repeats(texts, size):
    raws = [(i, (t or "").encode()) for i, t in texts]
    seen = collections.Counter(r[k : k + size] for _, r in raws for k in range(len(r) - size + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - size + 1):
            if seen[r[k : k + size]] > 1:
                gone[k : k + size] = True
        kept = bytes(x for x, g in zip(r, gone) if not g)
        out.append((i, len(r), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeated_passages(spark):
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefgé \n") for _ in range(n))
    shared = noise(420)
    texts = [(i, noise(150) + (shared[rng.randint(0, 150) :] if i % 2 else "") + noise(100)) for i in range(12)]
    texts += [(20, texts[0][1]), (21, "q" * 900), (22, "q" * 199), (23, None), (24, ""), (25, shared[:199]), (25, shared[:199]), (None, "xy" * 300)]
    got = passages.remove_repeats(_docs(spark, texts)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == _repeats(texts, 200)


def test_quotation_linking(spark):
    rows = [
        (1, 0, "u", "Hello there my friend\nhow are you doing today"), (1, 1, "a", "> Hello there my friend\nfine thanks a lot"),
        (1, 2, "u", "> > Hello there my friend\n> fine thanks a lot\nok good"), (1, 3, "u", ">  FINE  thanks a lot\nsecond"),
        (None, 1, "u", "> fine thanks a lot"), (1, None, "u", "x"), (2, 0, None, None), (2, 1, "u", "> nothing like this"), (1, 3, "u", ">  FINE  thanks a lot\nsecond"),
    ]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    got = sorted(((r.conv_id, r.turn, r.parent_turn, r.root_turn, r.depth, r.clean_text) for r in quoting.link(df).collect()), key=str)
    want = [
        (1, 0, None, 0, 0, "Hello there my friend\nhow are you doing today"), (1, 1, 0, 0, 1, "fine thanks a lot"), (1, 2, 1, 0, 2, "ok good"),
        (1, 3, 1, 0, 2, "second"), (1, 3, 1, 0, 2, "second"), (None, 1, None, 1, 0, ""), (1, None, None, None, 0, "x"), (2, 0, None, 0, 0, None), (2, 1, None, 1, 0, ""),
    ]
    assert got == sorted(want, key=str)
    assert quoting.link(df.limit(0)).count() == 0


def test_raking():
    cells = {("a", "x", "0"): 100.0, ("a", "y", "0"): 300.0, ("b", "x", "1"): 50.0, ("b", "y", "0"): 20.0}
    targets = [{"a": 0.5, "b": 0.5}, {"x": 0.4, "y": 0.6}, {"0": 0.9, "1": 0.1}]
    weights = mixing.rake(cells, targets)
    for j, target in enumerate(targets):
        for value, share in target.items():
            assert abs(sum(w for k, w in weights.items() if k[j] == value) - share) < 1e-6
    odds = mixing.calibrate(cells, weights, 150.0)
    assert abs(sum(odds[k] * cells[k] for k in odds) - 150) < 1e-6 and all(0 <= p <= 1 for p in odds.values())


def test_raking_says_what_it_cannot_meet():
    with pytest.warns(mixing.RakingWarning):
        mixing.rake({("a", "x"): 1.0, ("b", "y"): 1.0}, [{"a": 0.9, "b": 0.1}, {"x": 0.1, "y": 0.9}], rounds=40)


def test_topics_part_texts_by_their_words(spark):
    rng = random.Random(4)
    vocab = [[f"{x}{i}word" for i in range(40)] for x in "abc"]
    rows = [(i, " ".join(rng.choice(vocab[i % 3]) for _ in range(60)), "x") for i in range(300)]
    got = mixing.with_topics(spark.createDataFrame(rows, DOCS), topics=3).collect()
    kinds = collections.defaultdict(set)
    for r in got:
        kinds[r.doc_id % 3].add(r.topic)
    assert all(len(k) == 1 for k in kinds.values()) and len(set().union(*kinds.values())) == 3
    assert mixing.with_topics(spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x")], DOCS)).where("topic <> 0").count() == 0


def test_topics_are_fitted_on_all_texts(spark):
    """A topic of few texts, none of them among the 4,000 of the smallest hashes, is a centre; on the driver, in passes over tables and in any order of the rows alike."""
    rng = np.random.default_rng(6)
    vocab = [[f"{x}{i}word" for i in range(8)] for x in "abcd"]
    rows = [(i, " ".join(rng.choice(vocab[i % 3 if i < 8000 else 3], 12)), "x") for i in range(8200)]
    docs = spark.createDataFrame(rows, DOCS)
    early = {r.doc_id for r in docs.orderBy(F.xxhash64("text"), "text").limit(4100).select("doc_id").collect()}
    docs = docs.where(~F.col("doc_id").isin([i for i in early if i >= 8000])).cache()
    assert docs.where("doc_id >= 8000").count() > 50

    def topics(df, **more):
        return {r.doc_id: r.topic for r in mixing.with_topics(df, topics=4, **more).collect()}

    got = topics(docs)
    own = [{t for i, t in got.items() if (i % 3 if i < 8000 else 3) == k} for k in range(4)]
    assert all(len(t) == 1 for t in own) and len(set().union(*own)) == 4
    assert got == topics(docs.repartition(7, "text")) == topics(docs, driver_texts=1 << 20)


def test_mixing_rows(spark):
    rng = random.Random(3)
    rows = [(i, f"s{i % 3}", rng.choice(["en", "fr", None]), " ".join(rng.choice(["alpha", "betaa", "gamma"]) for _ in range(20))) for i in range(300)] + [(None, None, None, None), (5, "s2", "en", "alpha " * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, lang string, text string, weight int")
    counted = mixing.with_topics(df.drop("weight"), topics=2).cache()
    targets = [{"s0": 0.6, "s1": 0.2, "s2": 0.2}, None, {"0": 0.7, "1": 0.3}]
    probabilities = []
    for cells in (0, 1000):
        with pytest.warns(mixing.RakingWarning):  # both stop after as many rounds and say so
            out, names = mixing.mix(df.drop("weight"), targets, driver_cells=cells, tabled=counted, rounds=3)
        got = out.collect()
        assert len(got) == len(rows)
        spent = sum(r[names["probability"]] * r[names["n_tokens"]] for r in got)
        assert abs(spent - 0.5 * sum(r[names["n_tokens"]] for r in got)) < 1e-3 * spent
        assert any(r[names["kept"]] for r in got) and not all(r[names["kept"]] for r in got)
        probabilities.append(sorted((str(r.doc_id), r[names["probability"]], r[names["weight"]]) for r in got))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 and abs(a[2] - b[2]) < 1e-9 for a, b in zip(*probabilities))
    assert mixing.mix(df.limit(0))[0].count() == 0


def test_fold(spark):
    rows = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
