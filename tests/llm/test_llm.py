"""The training-data operators against brute force, and on awkward tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from twinfold.llm import bpe, decontaminate, gru_lm, hilbert, html_text, line_dedup, near_dup, packing, quality, secrets, token_files

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, keys string, shard string, n_tokens string"


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoin shrdlu".replace(" ", "")) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = [prose(rng, rng.randint(25, 60)) + "\n" + prose(rng, 30) for _ in range(16)]
    base = out[0].split(" ")
    for k in range(4):  # near copies
        out.append(" ".join(w if i != 5 + 9 * k else "changed" for i, w in enumerate(base)))
    out += [out[1], out[1]]  # copies
    out += [None, "", " \n\t ", "one two", "One  TWO", "é ñ\n\n\nx  y   ß 漢字 İ", "a\n" * 30, prose(rng, 30_000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", None if t is None else len(t), 1, "k", "s", "n") for i, t in enumerate(texts)]
    rows += [(None, "null id, " + texts[2], None, None, None, None, None, None, None), rows[3], rows[3]]  # a null id and repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collect(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))


def test_encoders_agree_with_the_library(texts):
    rng = random.Random(2)
    odd = ["a  b", " x", "x ", "\n", "a\n\n\nb", "a\n\n", "a\n", "it's 's '", "\t\r\x1c", "…“”—", "a— .b", "Ǆ ﬁ Σς", "x y", "　", "ab12,c_d é1é. x\x00y", "a" * 50 + " " + "a" * 49 + "b", "ĸ ŉ ſ × ÷ İ"]
    for added in ("<|endoftext|>", "<|startoftext|>"):
        odd += [added, f"hello {added} world", f"in{added}side word", f"a\n{added}", added.upper(), added[:-1], f"{added}{added} x"]
    odd += ["".join(rng.choice("ab '\n.é!1_ ") for _ in range(20)) for _ in range(200)]
    odd += ["".join(rng.choice(["ab", "cd ", ", ", "é", "12", " ", "\n", "—", "'s", "X"]) for _ in range(30)) for _ in range(200)]
    for kind, path in ((bpe.WordEncoder, WORD), (bpe.ByteEncoder, BYTE)):
        library = Tokenizer.from_file(path)  # as it comes
        for enc in (kind(path), kind(path, cache=50)):
            every = [t or "" for t in texts] + odd
            for t, ids in zip(every, enc.encode_all([t.encode() for t in every]), strict=True):
                assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t[:40]


def test_runs_of_one_hash_are_left_to_the_library(monkeypatch):
    texts = [b"one two three", b"", b"two, four"]
    want = [x.tolist() for x in bpe.ByteEncoder(BYTE).encode_all(texts)]
    monkeypatch.setattr(bpe.Runs, "keys", lambda runs, lead: (np.zeros(len(runs.start), np.uint64), np.arange(len(runs.start), dtype=np.uint64)))
    assert [x.tolist() for x in bpe.ByteEncoder(BYTE).encode_all(texts)] == want


def test_token_files(spark, docs, empty, tmp_path):
    out = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, WORD, out)
    rows = sorted(token_files.read_digest(spark, out).collect(), key=lambda r: r.start)
    enc = bpe.WordEncoder(WORD)
    want = [(r.doc_id, np.append(enc.encode((r.text or "").encode()), 2).astype("<u4")) for r in collect(docs.select("doc_id", "text"))]
    assert [r.doc_id for r in rows] == [d for d, _ in want] and rows[0].doc_id is None
    start = 0
    for r, (_, ids) in zip(rows, want, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    files = token_files.TokenFiles(out)
    assert len(files) == len(want) and all(files[i].tolist() == want[i][1].tolist() for i in range(len(want)))
    token_files.write_token_files(empty, WORD, out + "-none")
    assert token_files.read_digest(spark, out + "-none").count() == 0


def test_html():
    page = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body class=page><nav><a href=/>Home</a></nav><header>Site</header>
    <div id=content><h1>The  title</h1><p>First paragraph, with commas, and &eacute;&amp;amp; words that go on for a while.<p>Second,<br>of two <b>lines <i>here</b>.
    <form><input value=x>Search</form><ul><li>one<li>two</ul><div class="social-share">Share</div></div><aside>More</aside>
    <section class="comments"><p>A reader, who has, many commas, and a lot, to say, about it all.</p></section><footer>&copy; 2020</footer>"""
    assert html_text.main_text(page) == "The title\n\nFirst paragraph, with commas, and é&amp; words that go on for a while.\n\nSecond, of two lines here.\n\none\n\ntwo"
    assert html_text.main_text("") == "" and html_text.main_text("<p") == "<p" and html_text.main_text("<!-- x") == ""
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"


def test_html_scores_choose_the_container():
    long = "A sentence, with some commas, that is long enough to count, as text of an article does."
    menu = "".join(f"<div><a href=/{i}>Menu entry {i}, with a comma, and words</a></div>" for i in range(30))
    page = f"<body><div id=a>{menu}</div><div id=b><h2>Head</h2><p>{long} 1<p>{long} 2<div><p>{long} 3</div></div><div id=c><p>Short.</p></div></body>"
    assert html_text.main_text(page).split("\n\n") == ["Head", f"{long} 1", f"{long} 2", f"{long} 3"]
    split = f"<body><div>{menu}</div><div><div><p>{long} 1<p>{long} 2</div><div><p>{long} 3</p></div><div>{menu}</div></div></body>"
    assert html_text.main_text(split).split("\n\n") == [f"{long} 1", f"{long} 2", f"{long} 3"]  # a sibling is kept, a list of links isn't
    teasers = f"<main><div><p>{long} 1<p>{long} 2</div><div>{menu}</div></main>"
    assert "Menu" not in html_text.main_text(teasers.replace("main", "div"))
    head = f"<article><header><h1>Title</h1><nav>Home</nav>By me</header><p>{long}</p></article><header><h1>Site</h1></header>"
    assert html_text.main_text(head).split("\n\n") == ["Title", long]


def test_html_of_odd_markup():
    assert html_text.main_text("<p>First<p title=it's>Second") == "First\n\nSecond"
    assert html_text.main_text("<p title='a > b'>One</p><p a=\"x\">Two < three &lt;b&gt; &amp;amp; 4 > 3") == "One\n\nTwo < three <b> &amp; 4 > 3"
    assert html_text.main_text("<p>a &am<b>p; c</b>") == "a &amp; c" and html_text.main_text("<ul><li><p>a<li>b</ul>") == "a\n\nb"
    hostile = ["<a '", '<a x="', '<a x=">"', "<a ", "<", "<!--", "<script>", "<div>", "</", "<a =\"'", "<p>a<li>", "<b></i>", "<i><div><b>", "<ul><p></li>", "<td><h1>x"]
    for x in hostile:
        began = time.perf_counter()
        html_text.main_text(x * (500_000 // len(x)))
        assert time.perf_counter() - began < 6, x


def test_html_table(spark):
    pages = spark.createDataFrame([(1, None, "<article><p>Ti.</p></article>", 0), (None, "u", None, 0), (1, None, "<article><p>Ti.</p></article>", 0)], "page_id long, url string, html string, text long")
    assert sorted((r.page_id or -1, r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [(-1, "", 0), (1, "Ti.", 3), (1, "Ti.", 3)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_quality(docs, empty):
    for r, d in zip(collect(quality.judge(docs)), collect(docs.select("doc_id", "text")), strict=True):
        t = d.text or ""
        w = WORDS.findall(t)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        full = [x for x in t.split("\n") if WORDS.search(x)]
        assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (d.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.kept and r.base_failed)
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality.judge(docs).collect() if r.kept)
    assert quality.judge(empty).count() == quality.filter_documents(empty).count() == 0


def test_quality_order_does_not_matter():
    rng = random.Random(4)
    bad = [("### " * 30).encode(), ("LOUD!! " * 30).encode(), ("| a1 " * 30).encode(), prose(rng, 40).encode()]
    counts = np.asarray([quality.n_words(t) for t in bad])
    rules = list(quality.RULES.values())
    one = quality.cascade(bad, counts, np.ones(4, bool), rules)
    assert one.tolist() == quality.cascade(bad, counts, np.ones(4, bool), rules[::-1]).tolist() == [False, False, False, True]


def brute_secrets(text):
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 32])


def test_secrets(spark):
    rng = random.Random(9)
    parts = ["password", "Secret", "tokEN", "api_key", "apikey", "=", ":", " ", "'", '"', "abcdef12", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "é", "ſ", "\n", "-----BEGIN ", "PRIVATE KEY-----", "ghp_"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(1500)] + [(None, None), (7, "token=token:abcdefgh12")]
    for r, d in zip(collect(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))), sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        spans = brute_secrets(d[1] or "")
        shown = ",".join(f"{secrets.BASE[k].kind}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest(), d
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert [x for x in r.spans.split(",") if x.split(":")[0] in ("assign", "access", "hex")] == [x for x in shown.split(",") if x]
    assert len(secrets.Scanner().dfa.table) < 2000


def test_tiling_finds_reordered_passages(spark, empty):
    rng = random.Random(3)
    item = [prose(rng, 9) for _ in range(4)]
    other = prose(rng, 40)
    rows = [(1, prose(rng, 50) + " " + ". ".join(item[::-1]).upper() + " " + prose(rng, 50)), (2, prose(rng, 200)), (3, item[0]), (4, None), (None, " ".join(item)), (1, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(8, " ".join(item)), (9, "too short"), (10, None)], "item_id long, text string")
    sent = {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    assert {(r[0], r[1], r[3], r[4]) for r in sent} == {(1, 8, 36, 4), (None, 8, 36, 1)}
    assert {tuple(r) for r in decontaminate.contaminated(docs, bench, send_bytes=0).collect()} == sent
    assert sorted(r.text or "" for r in decontaminate.drop_contaminated(docs, bench).collect()) == sorted(["", rows[1][1], rows[2][1], other])
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 6


def tiling(item, doc, least):
    """Greedy string tiling by all pairs of places."""
    free_i, free_d, out = set(range(len(item))), set(range(len(doc))), []
    while True:
        best = (0, 0, 0)
        for j in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while i + n in free_i and j + n in free_d and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append((i, j, n))
        free_i -= set(range(i, i + n))
        free_d -= set(range(j, j + n))


def test_tiling_against_all_pairs():
    rng = np.random.default_rng(9)
    for trial in range(150):
        letters = int(rng.integers(1, 6))
        item = rng.integers(1, letters + 1, rng.integers(0, 30)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        doc = rng.integers(1, letters + 1, rng.integers(0, 60)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if trial % 2 and len(item) > 12:
            doc = np.concatenate([doc, item[7:], doc[:3], item[:9]])
        assert decontaminate.tile(item, doc, 3) == tiling(item.tolist(), doc.tolist(), 3)


def test_tiling_of_repeated_words_is_linear():
    bench = decontaminate.Benchmark([(1, b"a " * 2000), (2, b"a b " * 1000), (3, " ".join(f"w{i}" for i in range(500)).encode())])
    began = time.perf_counter()
    found = list(bench.held([b"a " * 20_000, b"b a " * 20_000 + b"a " * 3000, b""], decontaminate.COVER))
    assert time.perf_counter() - began < 6
    assert [(d, k) for d, k, *_ in found] == [(0, 0), (1, 0), (1, 1)]


def test_hilbert(spark, docs, empty):
    from itertools import product

    for n, b in ((2, 3), (3, 2)):
        cells = [f"c{i}" for i in range(n)]
        grid = spark.createDataFrame(list(product(range(1 << b), repeat=n)), ", ".join(f"{c} int" for c in cells))
        walk = hilbert.curve_index(grid.withColumns({"o" + c: grid[c] for c in cells}), cells, b).toPandas().sort_values("curve")
        at = walk[["o" + c for c in cells]].to_numpy()
        assert (walk.curve.to_numpy() == np.arange(len(walk))).all() and (abs(at[1:] - at[:-1]).sum(1) == 1).all()
    for k in (1, 5, 24, 100):
        rows = hilbert.shard_documents(docs, k).collect()
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        sizes = [len(slots[s]) for s in range(k)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert hilbert.shard_documents(empty).count() == 0


def test_shards_can_be_skipped(spark, docs, tmp_path):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 50), rng.choice(["de", "en", "es", "fr"]), f"src{rng.randint(0, 9)}", rng.randint(1, 9999)) for i in range(4000)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    dealt = hilbert.shard_documents(many, 24)
    sizes = {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t, *_ in rows}
    assert all(sizes[r.doc_id] == (r.size, r.text_crc32) for r in dealt.collect())
    ranges = hilbert.shard_ranges(dealt).collect()
    assert sum(r.rows for r in ranges) == 4000 and sum(r.bytes for r in ranges) == sum(n for n, _ in sizes.values())
    read = lambda d, v: sum(r[f"min_{d}"] <= v <= r[f"max_{d}"] for r in ranges)
    # a filter on any one column leaves about the square or cube root of the shards out of 24
    assert max(read("lang", v) for v in ("de", "en", "es", "fr")) <= 14
    assert sum(read("source", f"src{k}") for k in range(10)) / 10 <= 14 and sum(read("n_chars", v) for v in range(1, 9999, 500)) / 20 <= 14
    whole = docs.where("doc_id is not null").dropDuplicates(["doc_id"])  # it has a column called shard
    out = str(tmp_path / "shards")
    hilbert.write_shards(whole, hilbert.shard_documents(whole, 3), out)
    back = spark.read.parquet(out)
    assert back.count() == whole.count() and set(back.columns) == {*whole.columns, "shard_", "slot"} and {r.shard_ for r in back.select("shard_").distinct().collect()} == {0, 1, 2}


def test_columns_of_any_name(spark, docs):
    names = ["lost_doc_", "lost_twin_", "gone_", "doc_", "twin_", "tag", "left", "mark", "nth", "gone_id", "held_id_", "held_one_", "held_two_", "mark_", "DOC", "spread_"]
    wide = docs.selectExpr("*", *(f"'v' as `{n}`" for n in names))
    for made in (line_dedup.remove_lines(wide), near_dup.deduplicate(wide, 85, 100), quality.filter_documents(wide)):
        assert made.columns == wide.columns and made.count() > 0
    bench = wide.limit(1).selectExpr("1L as item_id", "'only these six words here now' as text")
    for most in (1 << 20, 0):
        assert decontaminate.drop_contaminated(wide, bench, send_bytes=most).columns == wide.columns


def linked(sets, num):
    """For each set the least index reachable by similarity of ``num`` % or more; empty sets are linked with nothing."""
    least = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= num * (len(sets[i]) + len(sets[j]) - both) and least[i] != least[j]:
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    return least


def line_oracle(rows, min_words=line_dedup.MIN_WORDS):
    """Which (document, line) places go, by all pairs of lines."""
    places = defaultdict(list)
    for d, t in rows:
        for i, x in enumerate((t or "").encode().split(b"\n")):
            if form := line_dedup.compared(x, min_words):
                places[form].append((d is None, d or 0, i))
    forms = list(places)
    least = linked([{f.decode()[i : i + 5] for i in range(len(f.decode()) - 4)} for f in forms], 80)
    groups = defaultdict(list)
    for i, f in enumerate(forms):
        groups[least[i]] += places[f]
    return {p for g in groups.values() for p in sorted(set(g))[1:]}


def test_line_dedup(spark, docs, texts, empty):
    gone = line_oracle([(r.doc_id, r.text) for r in docs.collect()])
    for r in line_dedup.line_counts(docs).collect():
        assert r.n_removed == sum((none, d) == (r.doc_id is None, r.doc_id or 0) for none, d, _ in gone), r.doc_id
    kept = line_dedup.remove_lines(docs)
    before = Counter((r.doc_id, r.text) for r in docs.collect())
    assert kept.columns == docs.columns and all((r.doc_id, r.text) in before or r.n_chars == len(r.text) and r.text.split() for r in kept.collect())
    assert line_dedup.remove_lines(empty).count() == line_dedup.line_counts(empty).count() == 0


def test_line_dedup_links_one_changed_character(spark):
    line = "the quick brown fox jumps over a lazy dog near our old mills"
    near = line[:30] + "#" + line[31:]
    five = [{x[i : i + 5] for i in range(len(x) - 4)} for x in (line, near)]
    assert 0.8 <= len(five[0] & five[1]) / len(five[0] | five[1]) < 0.86
    docs = spark.createDataFrame([(1, line), (2, near), (3, "nothing at all like the two others here")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.line_counts(docs).collect()} == {1: 0, 2: 1, 3: 0}
    assert (1 - 0.8**line_dedup.ROWS) ** line_dedup.BANDS <= 3e-4


def test_line_dedup_of_short_and_unspaced_lines(spark, tmp_path):
    from twinfold.llm.queries import op7_line_dedup

    script = "".join(chr(0x4E00 + i) for i in range(40))  # one word
    texts = ["All rights reserved.\nok", "all  rights reserved.\nOK\n\nno", f"{script}終\nabcd", f"{script}末\nabce", "one two three\n \n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.n_removed, r.text) for r in op7_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {0: (0, texts[0]), 1: (2, "\nno"), 2: (0, texts[2]), 3: (1, "abce"), 4: (0, texts[4])}


def shingles(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_dup(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    sets = [shingles(r.text) for r in rows]
    root = linked(sets, 85)
    least = {}
    for i, r in enumerate(rows):
        key = (r.doc_id is None, r.doc_id or 0)
        least[root[i]] = min(least.get(root[i], key), key)
    want = Counter((r.doc_id, len(s), None if least[root[i]][0] else least[root[i]][1]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.components(docs).collect()) == want
    kept = near_dup.deduplicate(docs, 85, 100)
    alone = sum(not s for s in sets)
    assert kept.columns == docs.columns and kept.count() == len({root[i] for i, s in enumerate(sets) if s}) + alone
    assert near_dup.components(empty).count() == near_dup.deduplicate(empty).count() == 0


def small_lists(monkeypatch):
    for name, value in {"BLOCK": 8, "MANY": 4, "CENTRES": 2, "MATRIX": 64}.items():
        monkeypatch.setattr(near_dup, name, value)


def test_large_lists_and_clusters_are_dealt_in_blocks(spark, monkeypatch):
    """Many different groups that share a passage, so in the same lists, and one large group."""
    rng = random.Random(8)
    base, passage, rows = prose(rng, 120).split(" "), prose(rng, 40), []
    for i in range(60):
        rows.append((i, " ".join(w if j != i else "other" for j, w in enumerate(base))))
    for g in range(40):  # one word of 88 changed: 83 of 93 shingles or so are shared
        own = prose(rng, 60).split(" ")
        for k in range(3):
            i = 100 + 3 * g + k
            rows.append((i, passage + " " + " ".join(w if j != 30 * k else "other" for j, w in enumerate(own))))
    want = {i: rows[k][0] for (i, _), k in zip(rows, linked([shingles(t) for _, t in rows], 85), strict=True)}
    assert sum(want[i] != i for i in want) > 100 and want[59] == 0
    small_lists(monkeypatch)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.components(docs).collect()} == want
    parts = near_dup.listed(near_dup.sign(docs)).select("j").distinct().collect()
    assert max(r.j for r in parts) > 0  # lists were cut in parts


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.85 among texts that share half of their words with all others."""
    rng = random.Random(21)
    shared, rows, pairs = prose(rng, 40), [], []
    for k in range(200):
        own = prose(rng, 75).split(" ")
        near = list(own)
        for j in (20, 50):
            near[j] = "other"
        pair = [f"{shared} {' '.join(x)}" for x in (own, near)]
        a, b = map(shingles, pair)
        assert 80 <= 100 * len(a & b) / len(a | b) <= 85
        pairs.append((2 * k, 2 * k + 1))
        rows += [(2 * k, pair[0]), (2 * k + 1, pair[1])]
    got = {r.doc_id: r.component_id for r in near_dup.components(spark.createDataFrame(rows, "doc_id long, text string"), 80, 100).collect()}
    assert all(got[b] == a for a, b in pairs) and all(got[a] == a for a, _ in pairs)


def test_linked_sets_agree_by_product_and_by_lists(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(60, rng.integers(1, 40), replace=False)).astype(np.uint64) for _ in range(60)]
    sets += [np.append(s, 100 + i).astype(np.uint64) for i, s in enumerate(sets[:20])]

    def parts(forest):
        of = list(range(len(sets)))
        for a, b in forest:
            of = [of[a] if x == of[b] else x for x in of]
        return [of.index(x) for x in of]

    by_product = parts(near_dup.linked_sets(sets, 80, 100))
    monkeypatch.setattr(near_dup, "MATRIX", 0)
    assert parts(near_dup.linked_sets(sets, 80, 100)) == by_product
    brute = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))]
    assert parts(brute) == by_product


def test_line_dedup_among_templated_lines(spark, monkeypatch):
    """Lines of one template that are alike to about 0.6, and pairs of 0.8 to 0.85 among them; long lists go by centres and cuts."""
    rng = random.Random(5)
    shared, lines = prose(rng, 12), []
    five = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    for _ in range(120):
        own = prose(rng, 9)
        near = own[:14] + "#" + own[15:-14] + "#" + own[-13:]
        pair = [f"{shared} {own}", f"{shared} {near}"]
        assert len(five(pair[0]) & five(pair[1])) / len(five(pair[0]) | five(pair[1])) >= 0.8
        lines += pair
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    want = sum(1 for _ in line_oracle([(i, x) for i, x in enumerate(lines)], 1))
    got = sum(r.n_removed for r in line_dedup.line_counts(docs, 1).collect())
    assert got == want >= 120
    for name, value in {"MANY": 4, "CENTRES": 2, "THINNED": 16, "LINES": 8}.items():
        monkeypatch.setattr(line_dedup, name, value)
    assert sum(r.n_removed for r in line_dedup.line_counts(docs, 1).collect()) == want


def test_gru_gradients_and_scores():
    rng = np.random.default_rng(2)
    net = gru_lm.Gru.initial(rng.random(1024) + 0.1)
    net.w = {k: w.astype(np.float64) for k, w in net.w.items()}
    x, y, h = rng.integers(0, 1024, (4, 5)), rng.integers(0, 1024, (4, 5)), rng.normal(size=(4, gru_lm.HIDDEN))
    grad, _, _ = net.gradients(x, y, h)
    for k, at in {"E": (x[0, 1], 3), "U": (2, 7), "C": (1, 4), "c": (3,), "O": (y[0, 0] // 32, 2, y[0, 0] % 32), "o": (y[0, 0] // 32, y[0, 0] % 32)}.items():
        own, ends = net.w[k][at], []
        for e in (1e-4, -1e-4):
            net.w[k][at] = own + e
            ends.append(-net.gradients(x, y, h)[2] / y.size)
        net.w[k][at] = own
        assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(grad[k][at], rel=1e-2, abs=1e-7)
    docs = [np.append(rng.integers(1, 1024, n), 0) for n in (3, 70, 0, 21)]
    assert net.score(docs) == pytest.approx([net.score([d])[0] for d in docs], rel=1e-5)


def test_lm(spark, docs, empty):
    rng = random.Random(6)
    phrases = ["red fish swims", "blue bird sings", "old dog sleeps"]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(40))) for i in range(200)]
    train = Counter(w for d, t in rows if not gru_lm.held_out(d) for w in [*t.split(), "\n"])
    n, v = sum(train.values()), len(train)
    got = collect(gru_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    for r, (d, t) in zip(got, rows, strict=True):
        tokens = [*t.split(), "\n"]
        base = sum(np.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d, zlib.crc32(str(d).encode()) % 5 == 1, len(tokens), len(tokens), n) and r.base_score == pytest.approx(base)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    odd = gru_lm.score_documents(docs).collect()
    assert len(odd) == docs.count() and all(np.isfinite([r.base_score, r.score]).all() for r in odd) and gru_lm.score_documents(empty).count() == 0


def test_model_is_a_distribution():
    lex = gru_lm.Lexicon([(b"a", 5), (b"b", 3)], 12, 3, 4, [0.5] * gru_lm.BUCKETS)
    net = gru_lm.Gru.initial(lex.start)
    h = np.zeros((1024, gru_lm.HIDDEN), np.float32)
    assert np.exp(net.outputs(h, np.arange(1024)).astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_packing_plan():
    rng = random.Random(1)
    for cap in (10, 64):
        for _ in range(60):
            counts = Counter(rng.randint(1, cap) for _ in range(rng.randint(0, 60)))
            bins, seen = defaultdict(list), Counter()
            for n, first, k, b, offset in packing.plan_packing(counts, cap):
                assert first == seen[n]
                seen[n] += k
                for i in range(k):
                    bins[b + i].append((offset, n))
            assert seen == counts
            for items in bins.values():
                at = 0
                for offset, n in sorted(items):
                    assert offset == at
                    at += n
                assert at <= cap and sum(3 * n > cap for _, n in items) <= 2
            assert len(bins) <= 11 * -(-sum(n * c for n, c in counts.items()) // cap) / 9 + sum(c for n, c in counts.items() if 2 * n > cap)


def test_packing(docs, empty):
    rows = packing.pack(docs, BYTE).collect()
    enc = bpe.ByteEncoder(BYTE)
    want = Counter()
    for d in docs.collect():
        ids = np.append(enc.encode((d.text or "").encode()), 0).astype("<u4")
        head, at, k = (len(ids) - 1) % 2048 + 1, 0, 0
        while at < len(ids):
            end = head if k == 0 else at + 2048
            want[d.doc_id, k, at, end - at, zlib.crc32(ids[at:end].tobytes())] += 1
            at, k = end, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:] + [(sum(n for _, n in own), 0)], strict=True)) and sum(n for _, n in own) <= 2048
    assert packing.pack(empty, BYTE).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame([(1, docs.where("doc_id = 5").first().text)], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    left = Counter(r.doc_id for r in now.collect())
    assert left[5] == 0 and left[0] + sum(left[i] for i in range(16, 20)) == 1 and left[4] == 1 and left[30] == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= sum(left.values())
