"""Runs, benchmark passages and the prefix trie against brute force."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from billstream.llm import prefix_trie as trie_module
from billstream.llm.periodic_runs import Tree, periodic_runs, run_digests, runs_of, stretches, word_runs
from billstream.llm.prefix_trie import prefix_trie
from billstream.llm.wu_manber import benchmark_hits, hit_digests

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, g long, words string, runs int, best int, spans int, items int, n_words int, `of` int"


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, *[None] * 8) for i, t in rows], DOCS).repartition(3)


# 11: runs


def brute_runs(w, least=24, periods=3):
    n, out = len(w), []
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            size = j + p - i
            if size >= max(least, periods * p) and j > i and not any(all(w[k] == w[k + q] for k in range(i, j + p - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def brute_run_digests(doc_id, text):
    w = SPLIT.findall(text or "")
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = [x for i, x in enumerate(w) if not any(s + p <= i < s + m for s, m, p in runs)]
    told = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hexed(told), hexed(" ".join(kept)))


def periodic(r, n, k):
    w = [f"w{r.randrange(k)}" for _ in range(n)]
    for _ in range(r.randint(0, 3)):
        if n:
            a = r.randrange(n)
            m = r.randint(1, n - a)
            part = w[a : a + r.randint(1, max(1, m // 2))]
            w[a : a + m] = [part[i % len(part)] for i in range(m)]
    return w


def test_extensions_and_runs_of_small_alphabets():
    r = random.Random(1)
    for _ in range(300):
        s = [r.randrange(r.randint(1, 4)) for _ in range(r.randint(1, 50))]
        tree = Tree([*s, -1])
        assert [[*s, -1][i:] for i in tree.order] == sorted([*s, -1][i:] for i in range(len(s) + 1))
        for least, periods in ((2, 2), (3, 3), (24, 3)):
            assert runs_of(s, least, periods) == brute_runs(s, least, periods)


def test_stretches_hold_all_runs():
    r, found = random.Random(2), 0
    for _ in range(400):
        w = [x.encode() for x in periodic(r, r.randint(0, 250), r.choice([2, 5, 50, 1000]))]
        want = brute_runs(w)
        found += len(want)
        assert word_runs(w) == want
        assert all(any(a <= s and s + n <= b for a, b in stretches(w)) for s, n, _ in want)
    assert found > 100


def test_run_digests(spark):
    r = random.Random(3)
    rows = [(i, " \n".join(periodic(r, r.randint(0, 120), r.choice([2, 9, 400])))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " \t\x0b\n "), (103, "a " * 23), (104, "a\x0ba " * 12), (None, "b c " * 30), (None, None), rows[5], rows[5], (105, "é x " * 40 + "\x1c"), (106, "long " * 20_000), (-7, "1 2 3 " * 9)]
    docs = docs_of(spark, rows)
    assert counted(run_digests(docs)) == collections.Counter(brute_run_digests(i, t) for i, t in rows if i != 106) + collections.Counter([brute_run_digests_of_one_word(106, 20_000)])
    assert run_digests(docs.limit(0)).count() == 0
    plain = {x.doc_id: x for x in periodic_runs(docs.where("doc_id in (104, 100)")).collect()}
    assert (plain[104].collapsed, list(map(tuple, plain[104].runs))) == ("a", [(0, 24, 1)]) and (plain[100].collapsed, plain[100].runs) == ("", [])


def brute_run_digests_of_one_word(doc_id, n):
    assert zlib.crc32(str(doc_id).encode()) % 10
    return (doc_id, 1, 0, n, 1, 1000 * n, hexed(f"0,{n},1\n"), hexed("long"))


# 12: benchmark passages


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def brute_hits(text, items):
    d, hit, its = alnum(text), set(), set()
    for name, item in items:
        w = alnum(item)
        m = min(10, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else ()
        for i in range(len(d) - m + 1):
            if tuple(d[i : i + m]) in windows:
                hit.update(range(i, i + m))
                its.add("" if name is None else str(name))
    return len(d), sorted(hit), sorted(its)


def messy(r, n, k):
    words = ["a", "B", "cé", "12", "x9", "Word", "ß", "zz"]
    return "".join(r.choice(words[:k]) + r.choice([" ", ", ", "\n", "--", "\t "]) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hits(spark, seed):
    r = random.Random(seed)
    k = (2, 3, 8)[seed - 1]
    items = [(r.choice([2, 10, 33, None]), messy(r, n, r.choice([k, 8]))) for n in (0, 1, 3, 5, 9, 10, 12, 30, 30)][seed // 2 :] + [(5, None), (6, "!?")]
    rows = [(i, messy(r, r.choice([0, 2, 11, 60, 300]), k)) for i in range(12)] + [(50 + j, messy(r, 5, k) + (t or "").upper() + messy(r, 3, k)) for j, (_, t) in enumerate(items)]
    rows += [(90, None), (91, ""), (None, rows[3][1]), rows[4], rows[4], (92, messy(r, 60_000, k) if seed == 3 else "")]
    docs = docs_of(spark, rows)
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    want = collections.Counter()
    for i, t in rows:
        n, hit, its = brute_hits(t, items)
        want[(i, n, len(hit), len(its), hexed(",".join(its)), bool(hit))] += 1
    assert counted(hit_digests(docs, table)) == want
    spans = collections.Counter((x.doc_id, x.n_words, tuple(i for s in x.spans for i in range(s.start, s.end)), tuple(x["items"])) for x in benchmark_hits(docs, table).collect())
    assert spans == collections.Counter((i, n, tuple(h), tuple(its)) for i, t in rows for n, h, its in [brute_hits(t, items)])
    blocks = benchmark_hits(docs, table, block_bytes=80)
    assert collections.Counter((x.doc_id, x.n_words, tuple(i for s in x.spans for i in range(s.start, s.end)), tuple(x["items"])) for x in blocks.collect()) == spans
    assert hit_digests(docs.limit(0), table).count() == 0
    assert {(x.n_hit, x.n_items, x.items_sha256) for x in hit_digests(docs, table.limit(0)).collect()} == {(0, 0, hexed(""))}


def test_windows_of_long_items_are_all_there(spark):
    words = [f"w{i}" for i in range(9000)]
    table = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = [(i, " ".join(words[i : i + 10])) for i in range(4080, 4110)] + [(1, "x " + " ".join(words[-10:])), (2, " ".join(words[7:16]))]
    got = {x.doc_id: x.n_hit for x in hit_digests(docs_of(spark, rows), table).collect()}
    assert got == {**{i: 10 for i in range(4080, 4110)}, 1: 10, 2: 0}


# 13: the prefix trie


def brute_trie(rows):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turn = (role or "", text or "")
            by[c].append((t is not None, t or 0, hashlib.sha256(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).digest(), turn))
    own = {c: [x[3] for x in sorted(v)] for c, v in by.items()}
    nodes, children, ends = collections.defaultdict(list), collections.defaultdict(set), collections.defaultdict(list)
    for c, turns in sorted(own.items()):
        h = zlib.crc32(str(c).encode()) % 6
        built = tuple(own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:])
        ends[built].append(c)
        for d in range(len(built) + 1):
            nodes[built[:d]].append(c)
            if d:
                children[built[: d - 1]].add(built[:d])
    out = []
    for node, members in nodes.items():
        todo, leaves, saved = [node], 0, 0
        while todo:
            v = todo.pop()
            leaves += not children[v]
            saved += (len(nodes[v]) - 1) * len(v[-1][1]) if v else 0
            todo += children[v]
        out.append((members[0], len(node), nodes[node[:-1]][0] if node else None, len(members), len(children[node]), leaves, saved, hexed(",".join(map(str, ends[node])))))
    return sorted(out)


def turns(r, convs, k, depth):
    return [(c, t, "ua"[t % 2], f"t{r.randrange(k)}") for c in convs for t in range(r.randint(0, depth))]


def trie_cases():
    r = random.Random(2)
    convs = [*range(-3, 12), 99, 100, 105, 205, -100, -105, None]
    awkward = [(r.choice(convs), r.choice([None, 0, 1, 2, 3, 4, 5, 6, 7, 50]), r.choice(["u", "a", None, ""]), r.choice(["x", "", None, "é" * 3])) for _ in range(200)]
    return [
        awkward + awkward[:9],
        turns(r, range(60), 2, 8) + turns(r, [*range(100, 130), *range(200, 260)], 1, 12),
        [(c, t, "u", "same") for c in (7, 9) for t in range(60)],
        [],
    ]


@pytest.mark.parametrize("case", range(4))
def test_trie(spark, monkeypatch, case):
    monkeypatch.setattr(trie_module, "RANGE_TURNS", 3)
    monkeypatch.setattr(trie_module, "CHUNK_IDS", 2)
    rows = trie_cases()[case]
    table = spark.createDataFrame([(*x, 1, 2, "s", 3) for x in rows], "conv_id long, turn long, role string, text string, place int, depth int, s0 string, leader int").repartition(3)
    assert sorted(map(tuple, prefix_trie(table).collect())) == brute_trie(rows)


def test_trie_with_colliding_fingerprints(spark, monkeypatch):
    """Base 1 makes the order of turns not count; that is noticed, and other bases are taken."""
    seeds, good = [], trie_module._bases
    monkeypatch.setattr(trie_module, "_bases", lambda seed: (seeds.append(seed), good(seed) if seed else [1] * 4)[1])
    rows = [(c, t, "u", x) for c, word in ((5, "aaaaaxy"), (6, "aaaaayx"), (8, "aaaaaxyz")) for t, x in enumerate(word)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefix_trie(table).collect())) == brute_trie(rows)
    assert seeds == [0, 1]
