"""Exact, near, line and substring deduplication against brute force on small tables."""

import hashlib
import random

import numpy as np
import pytest

from veritext.llm import line_dedup, near_dedup, substring_dedup
from veritext.llm.exact_dedup import exact_dedup

SPACES = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, id long, digest string, norm string, n long"


def table(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", 7, "x", "y", 0) for i, t in rows], DOCS)


def words(text):
    out = [text or ""]
    for s in SPACES:
        out = [w for x in out for w in x.split(s)]
    return [w for w in out if w]


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(60)]
    base = [[rng.choice(pool) for _ in range(rng.choice([3, 20, 60, 90]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(pool).upper()
        if rng.random() < 0.3:
            other = rng.choice(base)
            at = rng.randrange(len(w) + 1)
            w[at:at] = other[:15]
        rows.append((i * 3 % n, " ".join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "a a a a a a a a a a a a a a a a a a a a"), (n + 4, "b a a a a a a a a a a a a a a a c"), (n + 5, "one two three"), (n + 6, "x " * 5000 + "end"), (None, "lonely null id here")]
    return rows


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact(spark, digest_bytes):
    rows = corpus() + [(3, rows_text) for rows_text in ["same  text", "same\ttext"]] + [(1, "same text")]
    got = {}
    for r in exact_dedup(table(spark, rows), digest_bytes=digest_bytes, memtable_rows=5).collect():
        got.setdefault((r.doc_id, r.text_sha256), []).append((r.keep_id, r.group_size, r.kept))

    def norm(t):
        out, gap = [], False
        for c in t or "":
            if c in SPACES:
                gap = True
                continue
            if gap:
                out.append(" ")
                gap = False
            out.append(c)
        return "".join(out) + (" " if gap else "")

    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = {}
    for i, t in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        want.setdefault((i, hashlib.sha256(norm(t).encode()).hexdigest()), []).append((keep, len(g), i == keep))
    assert got == want


def test_exact_empty(spark):
    assert exact_dedup(table(spark, [])).count() == 0


def shingle_set(text):
    w = [x for x in words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def components(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t))
    ids = sorted(i for i in sets if i is not None)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if a < b and comp[a] != comp[b] and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                    low, high = sorted((comp[a], comp[b]))
                    comp = {k: low if v == high else v for k, v in comp.items()}
                    changed = True
    return comp


def test_near(spark):
    rows = corpus(2)
    comp = components(rows)
    for r in near_dedup.near_duplicates(table(spark, rows)).collect():
        text = dict(rows)[r.doc_id]
        assert r.n_shingles == len(shingle_set(text))
        assert r.component_id == (comp[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or comp[r.doc_id] == r.doc_id)


def test_near_in_blocks(spark, monkeypatch):
    """Parts cut into many blocks find the same links."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 100)
    rng = random.Random(5)
    w = [f"t{k}" for k in range(80)]
    rows = []
    for i in range(60):
        v = list(w)
        for _ in range(rng.choice([0, 1, 2, 3])):
            v[rng.randrange(80)] = f"e{i}"
        rows.append((100 - i, " ".join(v)))
    comp = components(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == comp


def test_near_empty_and_repeated_ids(spark):
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(table(spark, [(2, a), (2, b), (5, b), (1, a), (9, b)])).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (5, 1), (9, 1)]


def test_min_and_max_estimate_similarity():
    """Minima and maxima agree as often as the sets are similar."""
    rng = np.random.default_rng(0)
    both = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(both[:2500]), np.unique(both[500:])
    same = near_dedup.signature_bands(a, *near_dedup._permutations()) == near_dedup.signature_bands(a.copy(), *near_dedup._permutations())
    assert same.all()
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    p = near_dedup._permutations()
    hits = sum((near_dedup.signature_bands(a, *p) == near_dedup.signature_bands(b, *p)).tolist())
    assert abs(hits / near_dedup.BANDS - j**4) < 0.3


def repeats(rows):
    first = {}
    for i, t in rows:
        w, rank = words(t), 2**63 if i is None else i
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            first[key] = min(first.get(key, 2**63), rank)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < (2**63 if i is None else i):
                gone |= set(range(p, p + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_substring(spark, seed):
    rows = corpus(seed) + [(2, corpus(seed)[0][1]), (None, corpus(seed)[0][1])]
    got = substring_dedup.remove_repeats(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == repeats(rows)


@pytest.mark.parametrize("most", [0, 3])
def test_substring_with_a_short_copy_list(spark, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MAX_COPIES", most)
    rows = corpus(6)
    got = substring_dedup.remove_repeats(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == repeats(rows)


def test_substring_empty(spark):
    assert substring_dedup.remove_repeats(table(spark, [])).count() == 0


def test_symbols_are_consistent():
    """Every symbol whose deciding stretch lies in a window occurs wherever the window does, runs included."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        window = rng.integers(1, 4, 13).astype(np.uint64)
        seen = []
        for _ in range(2):
            names = np.concatenate([rng.integers(1, 4, rng.integers(0, 9)).astype(np.uint64), window, rng.integers(1, 4, rng.integers(0, 9)).astype(np.uint64), [np.uint64(99)]])
            at = next(k for k in range(len(names)) if (names[k : k + 13] == window).all())
            sym, start, end, low, high, bar = substring_dedup.recompress(names, np.append(np.zeros(len(names) - 1, dtype=bool), True))
            inside = (low >= at) & (high <= at + 13) & ~bar
            seen.append({(int(s), int(a - at), int(b - at)) for s, a, b in zip(sym[inside], start[inside], end[inside])})
        assert seen[0] == seen[1]


def shared_blocks(rows):
    """Lines of every block of MIN_CHARS or more that an earlier document has too, by trying all blocks; blank edges don't count."""
    lines = {i: [x.strip() for x in (t or "").split("\n")] for i, t in sorted(r for r in rows if r[0] is not None)}
    seen, out = set(), {}
    for i, ls in lines.items():
        blocks = [(s, e) for s in range(len(ls)) for e in range(s, len(ls)) if ls[s] and ls[e] and sum(map(len, ls[s : e + 1])) >= line_dedup.MIN_CHARS]
        out[i] = {k for s, e in blocks if tuple(ls[s : e + 1]) in seen for k in range(s, e + 1)}
        seen |= {tuple(ls[s : e + 1]) for s, e in blocks}
    return out


def test_frequent_line_goes_at_any_frequency(spark):
    common = "A licence line that very many documents carry at their end."
    rows = [(i, f"Something of its own in document {i} and no other.\n{common}") for i in range(150)]
    assert sum(r._n_removed for r in line_dedup.dedup_lines(table(spark, rows)).collect()) == 149


def check_lines(spark, rows):
    """Every line of a block of MIN_CHARS that an earlier document has goes, by all pairs and all blocks, and no other line."""
    want = shared_blocks(rows)
    got = line_dedup.dedup_lines(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id]
        kept, lines = (r.text or "").split("\n"), (text or "").split("\n")
        left = [x for k, x in enumerate(lines) if k not in want.get(r.doc_id, ())]
        # An aligned block takes the blank lines at its edges along.
        assert [x for x in kept if x.strip()] == [x for x in left if x.strip()] and len(kept) <= max(len(left), 1)
        assert r.text == text or r._n_removed > 0
        assert r._n_lines == (len(lines) if text else 0) and r._n_moved <= r._n_removed
    return got


def test_lines(spark):
    rng = random.Random(8)
    pool = [f"This is line number {k} of the shared pool of lines." for k in range(30)] + ["short", ""]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.4 else f"Own line {i} {k} that nobody else has at all." for k in range(rng.randrange(1, 8)))) for i in range(40)]
    rows += [(100, rows[5][1]), (101, None), (102, ""), (103, "\n\n"), (None, rows[5][1]), (104, "  " + rows[5][1] + "  ")]
    check_lines(spark, rows)
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0
    long = "\n".join(f"line {k} of a very long text" for k in range(20000))
    got = {r.doc_id: r._n_removed for r in line_dedup.dedup_lines(table(spark, [(1, long), (2, "head\n" + long)])).collect()}
    assert got == {1: 0, 2: 20000}


def test_lines_in_any_order(spark):
    a, b = "First long line that is shared by some of the documents.", "Second long line that is shared by some of the documents."
    rows = [(0, f"{a}\n{b}"), (1, f"{b}\n{a}\n{a}"), (2, "red apples grow"), (3, "blue plums fall"), (4, "red apples grow\n\nblue plums fall\nupon the grass"), (5, "own\nred apples grow\n\nblue plums fall\nupon the grass\nend"), (6, "red apples grow\nblue plums fall\nupon the grass")]
    rng = random.Random(9)
    pool = [f"pooled {k} " + "x" * rng.randrange(50) for k in range(12)] + ["", "short"]
    rows += [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(10, 60)] + [(60, None), (61, "")]
    got = {r.doc_id: (r._n_removed, r._n_moved) for r in check_lines(spark, rows)}
    assert got[1] == (3, 2) and got[5] == (4, 0) and got[6] == (0, 0)


def test_block_whose_lines_have_other_first_holders(spark):
    """Documents 3 and 4 share a block of 47 characters; its lines stand first, alone, in 1 and 2."""
    one, two = "the first half of a block", "the second half of it."
    rows = [(1, f"{one}\nother"), (2, f"another\n{two}"), (3, f"x\n{one}\n{two}"), (4, f"{one}\n{two}\ny")]
    got = {r.doc_id: r._n_removed for r in check_lines(spark, rows)}
    assert got == {1: 0, 2: 0, 3: 0, 4: 2}


def test_rows_of_one_id_are_cut_by_their_own_lines(spark):
    long = "A long line that the first document has as well as others."
    rows = [(1, long), (2, f"own\n{long}"), (2, f"{long}\nother\nthird")]
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(table(spark, rows)).collect())
    assert got == [(1, long), (2, "other\nthird"), (2, "own")]


def test_clashing_columns_pass_through(spark):
    long = "A long line that the first document has as well as others."
    docs = spark.createDataFrame([(1, long, 1, 2, 3, 4), (2, f"own\n{long}", 5, 6, 7, 8)], "doc_id long, text string, _id int, _maybe int, _doomed int, _key int")
    got = {r.doc_id: tuple(r)[:6] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: (1, long, 1, 2, 3, 4), 2: (2, "own", 5, 6, 7, 8)}


def test_patience():
    a, b = [b"x", b"a", b"b", b"c", b"y", b"d"], [b"q", b"a", b"b", b"c", b"d"]
    assert line_dedup.patience_blocks(a, b) == [(1, 1, 3), (5, 4, 1)]
    twice = [b"a", b"b", b"a", b"b"]
    assert line_dedup.patience_blocks(twice, twice) == [(0, 0, 4)]
    # Lines that are not unique in the whole are unique in a gap.
    assert line_dedup.patience_blocks([b"r", b"s", b"U", b"r", b"t"], [b"s", b"r", b"q", b"U", b"z", b"r", b"t"]) == [(0, 1, 1), (2, 3, 1), (3, 5, 2)]
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([b"%d" % rng.randrange(6) for _ in range(rng.randrange(9))] for _ in range(2))
        blocks = line_dedup.patience_blocks(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in blocks)
        assert all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] for p, q in zip(blocks, blocks[1:]))
