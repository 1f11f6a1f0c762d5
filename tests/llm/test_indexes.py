"""Spelling variants, WARC archives and the Merkle manifest: plain versions, round trips and edge cases."""

import collections
import gzip
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from floeframe.llm import merkle, spelling, warc
from floeframe.llm.common import Scratch
from floeframe.llm.warc import opened

DOCS = "doc_id long, text string, lang string, word string, n long, cell int, size int"      # names that the operators use themselves
PAGES = "page_id long, url string, html string, file string, key string, _hash string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "w", 1, 2, 3) for i, t in rows], DOCS)


# --- spelling ----------------------------------------------------------------------------------------------

def plain_words(rows, varied=31):
    found = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % varied == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n > 1}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, n[w], len(near[w]), form[w], form[w] and n[form[w]], root(w)) for w in n)


def variant_rows(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


@pytest.mark.parametrize("cell", [4096, 40])
def test_spelling_equals_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL", cell)                   # small cells: trees of cells, several ways for anagrams
    rng = random.Random(cell)
    base = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(7, 9))) for _ in range(60)] + ["ÀéÿéÀéÿ", "×÷×÷×÷×÷"]
    base += ["".join(p) for p in itertools.islice(itertools.permutations("abcdefg"), 0, 5040, 40)]
    rows = []
    for i in range(400):
        some = []
        for _ in range(30):
            w = rng.choice(base[:20] if rng.random() < 0.7 else base)
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("aest") + w[at:], w[:at] + rng.choice("aest") + w[at + 1:]])
            some.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(some)))
    rows += [(None, "alpha alphabets alphabets"), (None, "alpha alphabets alphabets"), (5, None), (6, ""), (7, "x" * 200_000 + " " + "x" * 200_000)]
    expected = plain_variants(rows)
    assert variant_rows(spelling.variants(docs(spark, rows), Scratch(spark, "t"))) == expected
    assert sum(1 for r in expected if r[3]) > 20


def test_spelling_follows_forms_to_the_last(spark):
    rows = [(i, " ".join(["letterings"] * 1000 + ["lettering"] * 100 + ["letterin"] * 10 + ["lettern"] * 1)) for i in range(2)]
    found = {r[0]: r for r in variant_rows(spelling.variants(docs(spark, rows), Scratch(spark, "t"), varied=None))}
    assert [found[w][5] for w in ("lettern", "letterin", "lettering", "letterings")] == ["letterings"] * 3 + ["letterings"]
    assert found["lettern"][3] == "letterin" and found["letterings"][3] is None


def test_spelling_without_rows(spark):
    assert spelling.variants(docs(spark, []), Scratch(spark, "t")).count() == 0
    assert spelling.variants(docs(spark, [(1, None), (2, "short words only")]), Scratch(spark, "t")).count() == 0


def test_tree_search_misses_nothing():
    rng = np.random.default_rng(3)
    vectors = rng.integers(0, 3, (500, spelling.PLACES)).astype(np.int8)
    got = {(int(a), int(b)) for rows, q in spelling.Tree(vectors, 8, tight=True).search(vectors[:80], 4, 4) for a in q for b in rows}
    d = vectors[:80, None].astype(int) - vectors[None].astype(int)
    within = (np.maximum(-d, 0).sum(2) <= 4) & (np.maximum(d, 0).sum(2) <= 4)
    assert {(int(a), int(b)) for a, b in zip(*np.nonzero(within))} <= got
    cells = spelling.Tree(vectors, 8, tight=False)
    assert sorted(int(a) for _, q in cells.search(vectors, 0, 0) for a in q) == list(range(500))       # one home each


# --- WARC --------------------------------------------------------------------------------------------------

def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "f", "k", "h") for i, u, h in rows], PAGES)


def archived(spark, rows, **more):
    scratch = Scratch(spark, "t")
    captures = warc.write_archives(pages(spark, rows), f"{scratch.root}/archives", scratch, **more)
    return scratch.root, captures, warc.write_index(captures, f"{scratch.root}/index", scratch)


def read_all(spark, rows, **more):
    root, _, parts = archived(spark, rows, **more)
    return warc.fetch(warc.lookup(warc.keys(pages(spark, rows)), parts, f"{root}/index"), f"{root}/archives").collect()


def test_warc_round_trip_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "LEAST_HOT", 20)
    rows = [(i, f"http://www.h{i % 13}.example.org:80/p/{i % 50}?q=a b#x", f"<p>{i % 40 if i % 3 else 'hot'} é</p>") for i in range(600)]
    rows += [(1000 + i, "http://hot.example/same", f"page {i}") for i in range(100)]
    got = {int(r["page_id"]): r for r in read_all(spark, rows)}
    assert len(got) == len(rows)
    by_text = collections.defaultdict(list)
    for i, _, html in rows:
        by_text[html].append(i)
    for i, url, html in rows:
        r, keep = got[i], max(by_text[html])
        assert (r["record_type"], r["refers_to"]) == (("response", None) if keep == i else ("revisit", str(keep)))
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == warc.digest_of(html.encode())
        assert (bytes(r["payload"]) == html.encode()) if keep == i else r["payload"] is None


def test_warc_lookup_finds_only_what_was_asked(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(i, f"https://a.example/{i // 10}", str(i)) for i in range(90)]
    root, _, parts = archived(spark, rows)
    ask = spark.createDataFrame([("example,a)/4",), ("example,a)/44",), ("zzz",), ("",)], "key string")
    found = warc.lookup(ask, parts, f"{root}/index")
    assert sorted(int(r["page_id"]) for r in found.collect()) == list(range(40, 50))


def test_warc_files_are_plain_gzip_members(spark):
    root, captures, _ = archived(spark, [(1, "http://a.example/", "one"), (2, None, "one")])
    text = b""
    for name in {r["file"] for r in captures.collect()}:
        fs, path = opened(f"{root}/archives/{name}")
        with fs.open_input_file(path) as f:
            text += gzip.decompress(f.read())
    assert text.count(b"WARC-Type: response") == 1 and text.count(b"WARC-Type: revisit") == 1 and b"\r\n\r\none\r\n\r\n" in text


def test_warc_edges(spark):
    rows = [(None, None, None), (None, "", ""), (3, "http://x.example/a\r\nX-Page-ID: 9", "tie"), (3, "http://x.example/b", "tie"), (2, "x", "tie"),
            (7, "http://x.example/a", "y" * 300_000)]
    got = sorted((r["page_id"], r["record_type"], r["refers_to"] or "", r["payload_bytes"]) for r in read_all(spark, rows))
    assert got == [("-", "response", "", 0), ("-", "response", "", 0), ("2", "revisit", "3", 3), ("3", "response", "", 3), ("3", "response", "", 3),
                   ("7", "response", "", 300_000)]
    assert read_all(spark, []) == []
    assert {r["record_type"] for r in read_all(spark, rows, min_bytes=4)} == {"response"}


def test_warc_refuses_damage():
    member, _ = warc.record("1", "http://a.example/", b"payload", None, "", "x")
    assert warc.parsed(member)[2] == b"payload"
    bad = gzip.compress(gzip.decompress(member).replace(b"payload", b"pAyload"))
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(bad)


@pytest.mark.parametrize("url, key", [("http://www.Example.com/Path?b=1#f", "com,example,www)/Path?b=1"), ("https://a.b:8443/x", "b,a:8443)/x"),
                                      ("http://u:p@a.b", "b,a)/"), (None, "-"), ("", "-"), ("a b", "a%20b)/")])
def test_url_key(url, key):
    assert warc.url_key(url) == key


# --- Merkle ------------------------------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i:i + 8])) for i in range(0, len(below), 8)])
    return levels


def plain_proof(levels, i):
    out = ""
    for level in levels[:-1]:
        start = i // 8 * 8
        out += "".join(level[j] for j in range(start, min(start + 8, len(level))) if j != i)
        i //= 8
    return out


def plain_leaf(i, source, lang, n_chars, text):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n_chars, text)))


def corpus(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int")


@pytest.mark.parametrize("steps", [1, 2, 3])
def test_merkle_equals_plain_trees(spark, monkeypatch, steps):
    monkeypatch.setattr(merkle, "BLOCK_HEIGHT", steps)
    rows = [(i, "s", "en", i, f"Text {i} é") for i in range(700, 0, -1)] + [(i, None, "de", None, None) for i in range(9)]
    rows += [(5, "s", "zz", 1, "One"), (None, "s", None, 2, ""), (None, "s", None, 2, ""), (3, "s", None, 2, "x" * 100_000)] + [(i, "s", f"l{i}", 1, "a") for i in range(20)]
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0], plain_leaf(*r)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: plain_levels([x[2] for x in sorted(groups[k])]) for k in langs}
    top = plain_levels([trees[k][-1][0] for k in langs])
    expected = []
    for at, k in enumerate(langs):
        for i, (_, did, leaf) in enumerate(sorted(groups[k])):
            expected.append((did or -1, leaf, trees[k][-1][0], top[-1][0], plain_proof(trees[k], i) + plain_proof(top, at)))
    proved = merkle.prove_all(corpus(spark, rows), Scratch(spark, "t"))
    got = proved.withColumn("folded", merkle.folded("altered", "pos", "n", "tree_pos", "n_trees", "proof")).collect()
    assert sorted((r["doc_id"] or -1, r["leaf"], r["subroot"], r["root"], bytes(r["proof"]).hex()) for r in got) == sorted(expected)
    assert {r["folded"] for r in got} == {top[-1][0]}


def test_merkle_tells_tampering(spark):
    from pyspark.sql import functions as F
    rows = [(i, "s", "en", 1, "Aa" if i % 2 else "aa") for i in range(70)]
    proved = merkle.prove_all(corpus(spark, rows), Scratch(spark, "t"), F.translate("text", merkle.UPPER, merkle.LOWER))
    got = proved.withColumn("ok", merkle.folded("altered", "pos", "n", "tree_pos", "n_trees", "proof") == F.col("root")).collect()
    assert all(r["ok"] == (r["doc_id"] % 2 == 0) for r in got)


def test_merkle_edges(spark):
    assert merkle.prove_all(corpus(spark, []), Scratch(spark, "t")).count() == 0
    one = merkle.prove_all(corpus(spark, [(1, "s", "en", 1, "x")]), Scratch(spark, "t")).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and bytes(one["proof"]) == b""


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_are_a_van_emde_boas_order(levels):
    places = merkle.addresses(levels)
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.nodes_in(levels)))

    def order(level, i, height):                                  # the recursive definition, node by node
        if height == 1:
            return [(level, i)]
        top = height // 2
        out = order(level, i, top)
        for j in range(8 ** top):
            out += order(level + top, i * 8 ** top + j, height - top)
        return out
    assert [int(places[d][i]) for d, i in order(0, 0, levels)] == list(range(merkle.nodes_in(levels)))
