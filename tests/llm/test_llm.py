import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from millrace.llm import decontamination, fingerprints, interpolation, jaccard, lookup, mixing, passages, quality, sharding, toxicity, urls
from millrace.llm.interpolation import score

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, n=60, seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(n):
        if texts and rnd.random() < 0.4:
            w = rnd.choice(texts).split()
            for _ in range(rnd.randrange(3)):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 2, 5, 40, 120, 400]))))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None), (None, "Alone here", "en", None, 3), (7, rows[7][1], "en", "s", 1), (901, "", "en", "s", 0)]
    return spark.createDataFrame(rows, SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


@pytest.mark.parametrize("over,k", [(90, 3), (80, 5)])
def test_jaccard_equals_brute_force(spark, over, k):
    docs, rows = corpus(spark)
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets if i is not None}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in combinations(sorted(root), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= over * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = Counter((i, len(sets[i]), None if i is None else find(i)) for i, *_ in rows)
    got = jaccard.join(docs, over=over, words=k).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert jaccard.join(empty(spark)).count() == 0


def test_jaccard_does_not_pair_a_crowd_of_edited_copies(spark, monkeypatch):
    rnd = random.Random(21)
    new = lambda: f"c{rnd.randrange(10**9)}"
    base = [new() for _ in range(400)]

    def edited(n):
        w = list(base)
        for at in rnd.sample(range(len(w)), n):
            w[at] = new()
        return w

    texts = [edited(rnd.choice([2, 8, 9, 10, 11])) for _ in range(140)]
    texts += [rnd.choice(texts)[rnd.randrange(90) :] for _ in range(20)]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in texts]
    alike = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    links = [(i, j) for i, j in combinations(range(len(sets)), 2) if alike(sets[i], sets[j])]
    root = list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, j in links:
        x, y = sorted((find(i), find(j)))
        root[y] = x
    assert 20 < len({find(i) for i in range(len(sets))}) < 140
    monkeypatch.setattr(jaccard, "CROWD", 4, raising=False)
    compared, possible = [], jaccard._possible
    monkeypatch.setattr(jaccard, "_possible", lambda pairs, *rest: compared.append(pairs.count()) or possible(pairs, *rest))
    got = jaccard.join(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"), over=80, words=5).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(len(sets))}
    assert compared[-1] < 1000, compared

    for lead in (0, len(texts) - 1):
        members = spark.createDataFrame([(lead, i, i, " ".join(w), " ".join(texts[lead])) for i, w in enumerate(texts)], "lead long, id long, root long, text string, lead_text string")
        found = {tuple(r) for r in jaccard._met_in_differences(jaccard._differences(members, 5, 80, 100), 80, 100).collect()}
        near = {i for i in range(len(texts)) if alike(sets[i], sets[lead])}
        assert {(i, j) for i, j in links if lead not in (i, j) and not {i, j} <= near} <= found


def test_signatures_meet_for_all_alike_sets():
    rnd = np.random.default_rng(5)
    for size in [*range(1, 60), 150, 700]:
        a = np.unique(rnd.integers(0, 2**63, size, dtype=np.uint64))
        cut = a[rnd.permutation(len(a))[: len(a) - len(a) // 10]]
        if len(cut) * 100 >= 90 * len(a) and len(cut) < len(a):
            assert np.intersect1d(jaccard.signatures(a), jaccard.signatures(cut)).size


def test_marginals_equal_enumeration():
    rnd = np.random.default_rng(2)
    e, a, first = rnd.normal(size=7), rnd.normal(size=(2, 2)), np.array([1, 0, 0, 1, 1, 0, 0], bool)
    total, tag = 0.0, np.zeros(7)
    for code in range(128):
        y = [(code >> i) & 1 for i in range(7)]
        w = math.exp(sum(e[i] * y[i] + (0 if first[i] else a[y[i - 1], y[i]]) for i in range(7)))
        total += w
        tag += w * np.array(y)
    assert np.allclose(toxicity.marginals(e, first, a)[0], tag / total)


def test_toxicity_edges(spark):
    docs, rows = corpus(spark)
    bad = spark.createDataFrame([(2000 + i, "awful filth " * 4 + f"x{i} y", "en", "s", 1) for i in range(60)], SCHEMA)
    every = docs.unionByName(bad)
    labels = spark.createDataFrame([(2000 + i, 1) for i in range(60)] + [(i, 0) for i in range(60)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(every, labels).collect()}
    assert all(got[2000 + i].predicted == 1 and got[2000 + i].spans for i in range(60))
    assert not any(got[i].predicted for i in range(60))
    assert got[900].held_out == (zlib.crc32(b"900") % 3 == 1)
    assert toxicity.judge(empty(spark), labels).count() == 0
    assert toxicity.judge(docs, labels.limit(0)).count() == len(rows)


def direct_sketch(t):
    """A fold over the text's shingles with whole numbers."""
    mask, out = (1 << 64) - 1, set()
    k = min(10, len(t))
    for i in range(len(t) - k + 1 if t else 0):
        h = k
        for c in t[i : i + k]:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) & mask
        for _ in range(2):
            h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & mask
        h = (h ^ (h >> 32)) >> 32
        if h < (1 << 32) // 8:
            out.add(h)
    return out


def test_sketches_merge_over_blocks(monkeypatch):
    text = "".join(random.Random(3).choice("abcdef ") for _ in range(5000))
    whole = fingerprints.sketch(text)
    monkeypatch.setattr(fingerprints, "BLOCK", 700)
    assert np.array_equal(whole[2], fingerprints.sketch(text)[2]) and set(whole[2].tolist()) == direct_sketch(text)
    parts = fingerprints.merge(fingerprints.sketch(text[:2600])[2], fingerprints.sketch(text[2591:])[2])
    assert np.array_equal(parts, whole[2])


def test_fingerprints_equal_a_fold(spark):
    docs, rows = corpus(spark)
    got = sorted(fingerprints.fingerprint(docs, ranges=5).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [r[1] or "" for r in order]
    for i, r in enumerate(got):
        t, n = texts[i], texts[(i + 1) % len(texts)]
        half = len(t) // 2
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
        own, edited, after = (direct_sketch(x) for x in (t, t[: len(t) - half] + n[:half], n))
        assert set(np.frombuffer(base64.b64decode(r.fingerprint.split(":")[2]), "<u4").tolist()) == own and r.fingerprint.startswith(f"{max(0, len(t) - 9) if len(t) >= 10 else min(1, len(t))}:")
        like = lambda a, b, same: 1.0 if same else len(a & b) / min(len(a), len(b)) if a and b else 0.0
        assert r.near_edited == like(own, edited, t == t[: len(t) - half] + n[:half]) and r.near_next == like(own, after, t == n)
    assert fingerprints.fingerprint(empty(spark)).count() == 0


def test_interpolation_counts(spark):
    docs, rows = corpus(spark)
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    count = Counter(w for i, t, *_ in rows if not held(i) for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    want = Counter((i, held(i), len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6)) for i, t, *_ in rows)
    got = score(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert score(empty(spark)).count() == 0


def test_held_out_score_beats_the_base(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(x for _ in range(40) for x in rnd.choice([("a", "b"), ("c", "d"), ("e", "f")])), "en", "s", 1) for i in range(80)]
    got = [r for r in score(spark.createDataFrame(rows, SCHEMA)).collect() if r.held_out]
    assert got and all(r.score > r.base_score for r in got)


def test_interpolation_weights_favour_what_predicts():
    grid = [{"b": 3, "w": 100, "p2": 0.5, "p1": 0.01}, {"b": 2, "w": 100, "p2": 0.0, "p1": 0.01}]
    out = interpolation.weights(grid, 1e-4)
    assert out[3][0] > 0.9 and out[2][0] < 0.1 and np.allclose(out.sum(1), 1)


def test_quality_prefers_trusted_words(spark):
    docs, rows = corpus(spark)
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(rows) and all(r.perplexity > 0 for r in got)
    assert quality.judge(empty(spark), labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).count() == len(rows)


@pytest.mark.parametrize("block,entries,head", [(4 << 20, 4_000_000, 16384), (300, 60, 3)])
def test_quality_against_direct_computation(spark, monkeypatch, block, entries, head):
    monkeypatch.setattr(lookup, "BLOCK", block)
    monkeypatch.setattr(lookup, "SHARD_ENTRIES", entries)
    monkeypatch.setattr(lookup, "HEAD", head)
    docs, rows = corpus(spark)
    rows = [(r[0], r[1], r[2]) for r in rows] + [(900, None, None), (901, "", "en"), (None, "w1 W2\tw3 unheard", "de"), (3, "w5 " * 4000, "en"), (3, "w5 " * 4000, "en")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, total string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    tokens = lambda t: ["<s>", *(t or "").lower().split(), "</s>"]
    train = Counter()
    for i, text, _ in rows:
        if i is not None and i < 40 and zlib.crc32(str(i).encode()) % 3 != 1:
            w = tokens(text)
            train.update(zip(w, w[1:]))
    fronts, total, kinds = Counter(w for _, w in train), Counter(), len(train)
    for (v, _), c in train.items():
        total[v] += c

    def rates(counts):
        n = [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        each = lambda k, a, b: min(k, max(0.01, k - (k + 1) * y * b / a)) if a else y
        d = each(1, n[0], n[1]), each(2, n[1], n[2]), each(3, n[2], n[3])
        return lambda c: d[min(c, 3) - 1] if c else 0.0

    high, low = rates(train.values()), rates(fronts.values())
    alone = lambda w: (fronts[w] - low(fronts[w])) / kinds + sum(map(low, fronts.values())) / kinds / (len(fronts) + 1)
    freed = Counter()
    for (v, _), c in train.items():
        freed[v] += high(c)
    chance = lambda v, w: (train[v, w] - high(train[v, w]) + freed[v] * alone(w)) / total[v] if total[v] else alone(w)
    for v in ("<s>", "w1"):
        assert abs(sum(chance(v, w) for w in [*fronts, "unheard"]) - 1) < 1e-9
    got = quality.judge(docs, labels).collect()
    want = sorted((str(i), len(tokens(t)) - 1, -sum(math.log(chance(v, w)) for v, w in zip(tokens(t), tokens(t)[1:])) / (len(tokens(t)) - 1)) for i, t, _ in rows)
    have = sorted((str(r.doc_id), r.n_tokens, math.log(r.perplexity)) for r in got)
    assert [x[:2] for x in want] == [x[:2] for x in have]
    assert not [(x, y) for x, y in zip(want, have) if abs(x[2] - y[2]) > 2e-5]


def test_passages_find_planted_ones(spark):
    rnd = random.Random(9)
    new = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    shared = new(70)
    fuzzy = list(shared)
    fuzzy[35] = "other"
    rows = [(1, " ".join(new(100) + shared + new(50))), (2, " ".join(new(30) + fuzzy + new(20))), (3, " ".join(shared)), (4, " ".join(new(300))), (5, None), (6, "")]
    got = {r.doc_id: r for r in passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {2, 3}
    assert (got[2].start, got[2].end, got[2].n_equal) == (30, 100, 69) and got[3].n_equal == 70
    assert passages.shared_passages(empty(spark)).count() == 0


def test_urls(spark):
    page = lambda u, c=None: (u, f'<link rel="canonical" href="{c}">' if c else "<p>")
    pages = [page("http://a.net/x", "http://EXAMPLE.org/es/1"), page("http://b.net/"), page("http://q.com/fr/1", "http://z.example.org/en/1"), page(None), page("nothing"), page("https://b.net#x", "http://a.net/x?")]
    rows = [(i, *p) for i, p in enumerate(pages)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].verdict for i in range(6)] == ["block", "allow", "allow", "allow", "allow", "allow"]
    assert got[2].rule == "com/fr/" and got[3].host == "" and got[5].host == "b.net"


def test_shards_and_mix_cover_all_rows(spark):
    docs, rows = corpus(spark)
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows) and all(r.taken <= 2 * r["size"] for r in mixed)
    assert sharding.shard(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_mix_follows_its_schedule(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "en", f"s{i % 3}", 1) for i in range(120)], SCHEMA)
    drawn = lambda: {r.doc_id: (r.taken, r.first_slot) for r in mixing.mix(docs, slots=256).collect()}
    one = drawn()
    assert drawn() == one and all((taken > 0) == (slot is not None) for taken, slot in one.values())
    monkeypatch.setattr(mixing, "GOLDEN", 0.5)
    other = drawn()
    assert {k: v[0] for k, v in other.items()} == {k: v[0] for k, v in one.items()}  # targets hold under any step
    assert sum(other[k][1] != one[k][1] for k in one) > 60


def test_decontamination_edges(spark):
    docs, rows = corpus(spark)
    bench = spark.createDataFrame([("q", " ".join(words(rows[next(i for i, r in enumerate(rows) if len(words(r[1])) > 100)][1])[5:30])), ("none", None)], "item_id string, text string")
    got = decontamination.decontaminate(docs, bench).collect()
    assert len(got) == len(rows) and any(r.contaminated for r in got)
    assert decontamination.decontaminate(empty(spark), bench).count() == 0


def test_lexicon_keeps_words_of_small_languages():
    rnd = random.Random(3)
    docs = [[f"e{rnd.randrange(500)}".encode() for _ in range(30)] + [b"idiot"] * (i < 300) for i in range(1500)]
    docs += [[f"d{rnd.randrange(500)}".encode() for _ in range(30)] + [b"dummkopf"] * (i < 20) for i in range(200)]
    toxic = np.array([i < 300 for i in range(1500)] + [i < 20 for i in range(200)], float)
    found = toxicity.lexicon(docs, toxic)
    assert {b"idiot", b"dummkopf"} <= found and len(found) <= 4


def test_clean_drops_rows_by_their_own_text(spark):
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(None, f"before {item} after"), (None, "clean one"), (None, None), (1, item), (1, "clean two"), (1, "clean two"), (2, ""), (3, item.upper())]
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    got = decontamination.clean(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert Counter(map(tuple, got)) == Counter([(None, "clean one"), (None, None), (1, "clean two"), (1, "clean two"), (2, "")])


def test_deduplicate_judges_rows_of_one_id_by_their_sets(spark):
    rnd = random.Random(6)
    new = lambda: " ".join(f"z{rnd.randrange(10**6)}" for _ in range(80))
    a, b, c, d, e = (new() for _ in range(5))
    rows = [(5, a + " end"), (7, a), (7, b), (8, b), (9, c), (9, d), (9, e), (9, d), (10, ""), (10, None), (None, a), (None, a)]
    got = jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(5, a + " end"), (7, b), (9, c), (9, d), (9, e), (10, ""), (10, None), (None, a), (None, a)])


def test_passages_find_all_fuzzy_ones_of_a_pair(spark):
    rnd = random.Random(12)
    new = lambda n: [f"u{rnd.randrange(10**6)}" for _ in range(n)]
    first, second, third = new(100), new(60), new(54)
    fuzzy = second[:28] + new(3) + second[31:]
    ends = third[:5] + new(1) + third[6:47] + new(2) + third[49:]
    one = first + new(100) + second + new(200) + third + new(10)
    two = new(20) + first + new(100) + fuzzy + new(200) + ends + new(30)
    rows = [(1, " ".join(one)), (2, " ".join(two))]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.start, r.end, r.n_equal) for r in got) == [(20, 120, 100), (220, 280, 57), (480, 534, 51)]
    assert [len(c) for c in passages.chains([(x, x) for x in range(0, 400, 4)] + [(x + 100, x + 100) for x in range(400, 440, 4)])] == [100, 10]


def test_quality_rejects_as_many_as_labels_call_poor(spark):
    rnd = random.Random(8)
    text = lambda kind: " ".join(f"{kind}{rnd.randrange(40)}" for _ in range(60))
    poor = lambda i: i % 4 == 0
    docs = spark.createDataFrame([(i, text(f"p{i}x" if poor(i) else "g"), "en" if i < 200 else None) for i in range(240)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(not poor(i))) for i in range(160)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == 240 and all(r.keep != poor(r.doc_id) for r in got)
    assert quality.parting({1: (0, 5), 4: (5, 0)}) == 2 and quality.parting({1: (0, 5)}) is None


def test_urls_follow_relative_and_loosely_written_links(spark):
    link = lambda h: f'<link rel="canonical" href="{h}">'
    pages = [
        ("http://m.example.org/es/1", "<p>", "block"), ("http://s.net/a", '<LINK REL="CANONICAL" HREF="http://m.example.org/es/1">', "block"),
        ("https://t.net/b", link("//m.example.org/es/1"), "block"), ("http://s.net/c/d.html?z=/", link("./../a"), "block"),
        ("http://s.net/e?x", "<link href='/a' rel='canonical'>", "block"), ("http://s.net", link("a"), "block"),
        ("http://w.net/", '<meta http-equiv="Refresh" content="0; URL=http://m.example.org/es/1">', "block"),
        ("http://v.net/?p=1&q=2", "<p>", "block"), ("http://m.example.org/es/7", link("http://v.net/?p=1&amp;q=2"), "block"),
        ("http://x.net/q/r", link("?p=http://m.example.org/es/1"), "allow"), ("http://y.net/1", link("mailto:a@m.example.org"), "allow"), ("none", link("/a"), "allow"), (None, link("/a"), "allow"),
    ]
    rows = [(i, u, h) for i, (u, h, _) in enumerate(pages)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(pages))] == [p[2] for p in pages]


def test_passages_reach_over_batches(spark, monkeypatch):
    """Recall of planted fuzzy passages against brute force over all pairs, with several documents of one id, null ids and copies; the same rows from small batches."""
    rnd = random.Random(21)
    new = lambda n: [f"k{rnd.randrange(10**6)}" for _ in range(n)]
    planted = [new(rnd.randrange(60, 120)) for _ in range(12)]
    texts = []
    for i in range(90):
        w = new(rnd.randrange(80))
        for _ in range(rnd.randrange(3)):
            p = list(rnd.choice(planted))
            for _ in range(rnd.randrange(4)):
                p[rnd.randrange(len(p))] = f"x{rnd.randrange(10**6)}"
            w += p + new(rnd.randrange(40, 90))
        texts.append(" ".join(w))
    rows = [(None if i % 11 == 0 else i // 2, t) for i, t in enumerate(texts)] + [(3, texts[6]), (500, texts[5]), (501, "")]
    sets = [{" ".join(t.split()[j : j + 25]) for j in range(len(t.split()) - 24)} for _, t in rows]
    order = lambda i: (rows[i][0] is not None, rows[i][0] or 0)
    want = {rows[j][0] for i in range(len(rows)) for j in range(len(rows)) if i != j and order(i) < order(j) and sets[i] & sets[j]}
    results = []
    for size in (400_000, 300):
        monkeypatch.setattr(passages, "BATCH_WORDS", size)
        got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string"), least=50).collect()
        found = {r.doc_id for r in got}
        assert len(want & found) >= 0.9 * len(want) and all(r.n_equal >= 0.7 * (r.end - r.start) for r in got)
        results.append(found)
    assert len(results[0] ^ results[1]) <= 0.1 * len(want)


def test_interpolation_equals_brute_force(spark, monkeypatch):
    """Scores by counting with dictionaries, from small blocks and many shards; chances of all words after a context sum to 1."""
    from millrace.llm import exchange

    monkeypatch.setattr(exchange, "BLOCK", 2000)
    monkeypatch.setattr(exchange, "SHARD_TOKENS", 500)
    rnd = random.Random(31)
    texts = [" ".join(f"t{min(rnd.randrange(30), rnd.randrange(30))}" for _ in range(rnd.choice([0, 3, 60]))) for _ in range(70)]
    rows = [*enumerate(texts), (3, texts[5]), (None, "t1 t2 nowhere"), (200, None), (201, "T1 " * 3000)]
    kept = {}
    monkeypatch.setattr(interpolation, "weights", lambda grid, uniform, f=interpolation.weights: kept.setdefault("mix", f(grid, uniform)))
    got = score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    mix = interpolation.proper(kept["mix"])
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    tokens = lambda t: ["<", "<", *words(t), ">"]
    count, ctx = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            for j in range(2, len(w)):
                count.update([(w[j],), (w[j - 1], w[j]), (w[j - 2], w[j - 1], w[j])])
                ctx.update([(), (w[j - 1],), (w[j - 2], w[j - 1])])
    kinds = [k[0] for k in count if len(k) == 1]

    def chance(a, b, w):
        n3, n2 = ctx[a, b], ctx[b,]
        own = mix[64 + int(math.log2(n3 + 1)) if n3 else int(math.log2(n2 + 1))]
        return own[0] * (count[a, b, w] / n3 if n3 else 0) + own[1] * (count[b, w] / n2 if n2 else 0) + own[2] * count[w,] / ctx[()] + own[3] / (len(kinds) + 1)

    want = Counter((i, held(i), round(sum(math.log10(chance(*w[j - 2 : j + 1])) for j in range(2, len(w))), 5)) for i, w in ((i, tokens(t)) for i, t in rows))
    assert Counter((r.doc_id, r.held_out, round(r.score, 5)) for r in got) == want
    for a, b in (("<", "<"), ("<", "t1"), ("t1", "t2"), ("never", "t2"), ("never", "seen")):
        assert abs(sum(chance(a, b, w) for w in [*kinds, "unknown"]) - 1) < 1e-9


def test_interpolation_of_a_long_held_out_text(spark):
    """A text that is worked on by itself and that no training token comes from."""
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(held, "a b " * 100_001), *((i, "a b c") for i in range(100, 110))]
    got = {r.doc_id: r for r in score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 11 and got[held].n_tokens == 200_003 and got[held].score < 0


def test_a_block_costs_no_more_for_many_shards(spark, monkeypatch):
    """The counts of one block from one shard and from over 5000, which may add what so many small rows cost, but not so many looks at the whole block."""
    import time

    from millrace.llm import exchange

    rnd = np.random.default_rng(5)
    rows = [(i, i % 3 == 0, " ".join(f"w{x}" for x in rnd.integers(0, 10**6, 8000))) for i in range(100)]
    base = spark.createDataFrame(rows, "id long, held boolean, text string").repartition(1).cache()
    base.count()
    found, took = [], []
    for tokens in (10**9, 300):
        monkeypatch.setattr(exchange, "SHARD_TOKENS", tokens)
        began = time.time()
        got = exchange.counted(base).collect()
        took.append(time.time() - began)
        assert len(got) == 1 and sum(r.total for r in got) == sum(len(t.split()) + 1 for _, held, t in rows if not held)
        found.append([exchange.spread(got[0][c]) for c in ("one", "two", "three")])
    assert all(np.array_equal(x, y) for x, y in zip(*found)) and took[1] < took[0] + 12, took


def test_packed_numbers_come_back():
    from millrace.llm import exchange

    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        assert np.array_equal(exchange.unpack_sorted(exchange.pack_sorted(keys)), keys)
        small = rnd.integers(0, 70000, n)
        assert np.array_equal(exchange.spread(exchange.squeeze(small)), small)


def test_pipeline_keeps_clean_rows(spark, tmp_path):
    """Each stage on rows with null, shared and repeated ids, empty texts and columns with the names that stages use inside; exact survivors."""
    import corpus_pipeline as pipeline

    rnd = random.Random(77)
    new = lambda n: " ".join(f"n{rnd.randrange(10**6)}" for _ in range(n))
    base, item, toxic = new(100), new(12), "awful filth " * 6
    labelled = [(1000 + i, toxic + new(4) if i % 2 else new(30), "en", "s", 1) for i in range(160)]
    extra = "id long, times int, copy int, gone int, bad_id long, score double, spans string"
    rows = [(1, base), (2, base + " end"), (None, base), (None, new(20)), (None, f"{item} q"), (4, new(20)), (4, f"x {item}"), (5, new(15)), (5, new(15)), (6, ""), (7, None), (8, toxic), (9, new(25)), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "ab"[k % 2], 7, 1, 77, 77, 77, None, 0.9, "z") for k, (i, t) in enumerate(rows)], SCHEMA + ", " + extra)
    documents = spark.createDataFrame(labelled, SCHEMA)
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, (i - 1000) % 2) for i, *_ in labelled], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = lambda i, d: pipeline.STAGES[i][1](spark, d, str(tmp_path))
    texts = lambda d: Counter((r.doc_id, r.text) for r in d.collect())
    everything = Counter(rows)
    assert texts(run(0, docs)) == everything - Counter([(8, toxic)])
    assert texts(run(1, docs)) == everything - Counter([(2, base + " end")])
    assert texts(run(2, docs)) == everything - Counter([rows[4], rows[6]])
    mixed = run(3, docs)
    drawn = texts(mixed)
    assert {k for k in drawn} <= set(rows) and max(drawn.values()) <= 2 and all((r.times, r.copy, r.id) == (77, 77, 1) for r in mixed.select("id", "times", "copy").collect())
    words_of = lambda k: sum(len(words(t)) for (_, t), n in drawn.items() if rows.index((_, t)) % 2 == k for _ in range(n))
    size = [sum(len(words(t)) for n, (_, t) in enumerate(rows) if n % 2 == k) for k in (0, 1)]
    first = min(2 * size[0], 1.5 * sum(size) * 5 / 7)
    goals = (first, min(2 * size[1], 1.5 * sum(size) - first))
    assert all(abs(words_of(k) - goals[k]) <= 110 for k in (0, 1))
    shards = run(4, docs)
    assert shards.count() == len(rows) and shards.filter("size is null").count() == 0
    for i in range(5):
        assert run(i, docs.limit(0)).count() == 0 and (i == 4 or run(i, docs).columns == docs.columns)
    twice = docs.unionByName(docs)
    assert texts(run(2, twice)) == Counter({k: 2 * n for k, n in texts(run(2, docs)).items()})
    assert sum(texts(run(3, twice)).values()) >= sum(drawn.values())


def test_shards_are_near_equal_and_slots_hold_what_the_map_says(spark, tmp_path):
    docs, rows = corpus(spark, 300, 8)
    got = sharding.shard(docs, 4, 256, store=str(tmp_path / "map")).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    load, weight, home = Counter(), Counter(), {}
    for r in got:
        load[r.shard] += r["size"]
        weight[r.vslot] += r["size"]
        assert home.setdefault(r.vslot, r.shard) == r.shard
    want = sharding.assign(weight, 4, 256)
    assert all(want[v] == s for v, s in home.items()) and max(load.values()) - min(load.values()) <= max(weight.values())
    stored = spark.read.parquet(str(tmp_path / "map"))
    assert stored.count() == 256 and {r.version for r in stored.collect()} == {0}


def test_rebalancing_moves_few_slots(spark):
    rnd = random.Random(14)
    weight = {s: rnd.randrange(1, 100) for s in range(200)}
    first = sharding.assign(weight, 5, 200)
    loads = lambda m: Counter({k: sum(w for s, w in weight.items() if m[s] == k) for k in set(m)})
    assert max(loads(first).values()) - min(loads(first).values()) <= max(weight.values())
    more = sharding.rebalance(first, weight, 6)
    moved = [s for s in range(200) if more[s] != first[s]]
    assert sum(weight[s] for s in moved) <= 1.3 * sum(weight.values()) / 6 and max(loads(more).values()) - min(loads(more).values()) <= 2 * max(weight.values())
    fewer = sharding.rebalance(first, weight, 4)
    assert set(fewer) == set(range(4)) and all(fewer[s] == first[s] for s in range(200) if first[s] < 4 and fewer[s] == first[s])
    assert all(first[s] == 4 for s in range(200) if fewer[s] != first[s] and weight[s] > max(loads(first).values()) - sum(weight.values()) / 4 + max(weight.values()))
    heavy = dict(weight)
    for s in (s for s in range(200) if first[s] == 0):
        heavy[s] *= 4
    after = sharding.rebalance(first, heavy, 5)
    spread = lambda m: max(x := [sum(w for s, w in heavy.items() if m[s] == k) for k in range(5)]) - min(x)
    assert spread(after) < spread(first) / 4 and all(after[s] == first[s] or first[s] == 0 for s in range(200))
    table = sharding.map_table(spark, [first, more])
    assert {r.vslot: r.shard for r in sharding.latest(table).collect()} == dict(enumerate(more)) and table.filter("version = 0").count() == 200


def test_verdicts_reach_all_aliases(spark):
    """Blocks carried through canonical links, refreshes and given redirects on generated pages, against a search by hand."""
    rnd = random.Random(40)
    hosts = ["example.org", "a.example.org", "b.com", "c.net", "d.net"]
    names = [f"http://{rnd.choice(hosts)}/{rnd.choice(['es', 'en', 'fr', 'de', 'x'])}/{i}" for i in range(1500)]
    pages, near = [], {i: set() for i in range(1500)}
    redirects = []
    for i, u in enumerate(names):
        html = "<p>"
        if rnd.random() < 0.45:
            j = rnd.randrange(max(0, i - 40), min(1500, i + 40))
            near[i].add(j)
            near[j].add(i)
            kind = rnd.randrange(3)
            if kind == 2:
                redirects.append((u, names[j]))
            else:
                html = f'<link rel="canonical" href="{names[j]}">' if kind else f'<meta http-equiv="refresh" content="0;url={names[j]}">'
        pages.append((i, u, html))
    for i in range(1, 300):  # a hub
        if i % 7 == 0:
            redirects.append((names[i], names[0]))
            near[0].add(i)
            near[i].add(0)
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

    def rule(u):
        host, path = re.match(r"http://([^/]+)(.*)", u).groups()
        fits = [(len(h) + len(p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    own, want, seen = [rule(u) for u in names], {}, set()
    for i in range(1500):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        said = {own[j][0] for j in group}
        for j in group:
            want[j] = (own[j][1], own[j][0] or ("block" if "block" in said and "allow" not in said else "allow"))
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(redirects, "url string, target string"))
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == want
    assert sum(r is None and v == "block" for r, v in want.values()) > 20
