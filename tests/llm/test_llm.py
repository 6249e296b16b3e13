"""The training-data operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows,
empty tables, and extra columns with clashing names."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from vectorloom.llm import decontaminate, exact_dedup, html_extract, licenses, mixing, pii, simhash, substring_dedup, token_counts, toxicity
from vectorloom.llm.common import words_of
from vectorloom.llm.oracles import ORACLES, mixing_sql
from vectorloom.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, run int, id string, h string, fp long, keep_id long, digest string"


def docs(spark, texts, ids=None, **columns):
    """Documents whose extra columns have the names that operators use inside."""
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, columns.get("lang", "en"), columns.get("source", "src1"), len(t or ""), 7, "x", "y", 1, 2, "z") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


WORDS = [f"w{i}" for i in range(40)]


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"t{rng.integers(vocabulary)}x" for _ in range(n))


AWKWARD = [None, "", " ", "a", "a", "A b. c", "É é\n\tß", "x" * 50_000, "word " * 30_000, "😀 　 \x00", prose(1, 120), prose(1, 120)]


# --- op10

def test_exact_dedup(spark):
    for keep, pick in (("max", max), ("min", min)):
        df = docs(spark, AWKWARD)
        got = {r.doc_id: r for r in exact_dedup.exact_duplicates(df, keep=keep, fan_in=2, runs=8).collect()}
        groups = defaultdict(list)
        for i, t in enumerate(AWKWARD):
            groups[t or ""].append(i)
        assert len(got) == len(AWKWARD)
        for t, members in groups.items():
            for i in members:
                assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (pick(members), len(members), i == pick(members), hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_repeats_and_empty(spark):
    df = docs(spark, ["a", "a", "b", None, "c", "d"], [1, 1, 1, 2, None, None])
    rows = exact_dedup.exact_duplicates(df).collect()
    assert sorted((r.text_sha256[:4], r.group_size, r.kept) for r in rows if r.doc_id == 1) == sorted([(hashlib.sha256(b"a").hexdigest()[:4], 2, True), (hashlib.sha256(b"a").hexdigest()[:4], 2, False), (hashlib.sha256(b"b").hexdigest()[:4], 1, True)])
    left = exact_dedup.drop_exact_duplicates(df)
    assert left.columns == df.columns and sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == [(-1, "c"), (-1, "d"), (1, "a"), (1, "b"), (2, "")]
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0 and exact_dedup.drop_exact_duplicates(df.limit(0)).count() == 0


# --- op7

def slow_fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    n = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if n[b] * 2 > len(grams))


@given(st.text(max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def classes(fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return [root(i) for i in range(len(fps))]


def test_slices_of_long_texts():
    text = prose(2, 300)
    old, simhash.SLICE = simhash.SLICE, 7
    try:
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)
    finally:
        simhash.SLICE = old


@pytest.mark.parametrize("pair_limit", [1, 3, 48])
def test_links(spark, pair_limit):
    rng = np.random.default_rng(4)
    seeds = [int(x) for x in rng.integers(0, 1 << 63, 12)] + [0, 1 << 63]
    fps = sorted({s ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for s in seeds for k in (0, 1, 2, 2, 3, 4) for _ in range(3)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), pair_limit).collect()
    at = {s: i for i, s in enumerate(signed)}
    assert all((fps[at[e.a]] ^ fps[at[e.b]]).bit_count() <= 2 for e in edges)
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        a, b = sorted((root(at[e.a]), root(at[e.b])))
        parent[b] = a
    assert [root(i) for i in range(len(fps))] == classes(fps)


def test_near_duplicates_with_repeated_ids(spark):
    """Three equal texts with ids 1, 1, 2, of which 2 is also the id of another text; null ids; each group keeps one row."""
    a, b, c = prose(3, 60), prose(4, 60), prose(5, 60)
    left = simhash.drop_near_duplicates(docs(spark, [a, a, a, b, c, c], [1, 1, 2, 2, None, None])).collect()
    assert sorted((r.doc_id or -1, r.text) for r in left) == sorted([(1, a), (2, b), (-1, c)])


def test_near_duplicates(spark):
    long = prose(3, 400).split()
    near = [" ".join([*long[:k], "new", *long[k + 1 :]]) for k in range(0, 400, 40)]
    texts = [*AWKWARD, " ".join(long), *near]
    df = docs(spark, texts)
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == classes(fps)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(classes(fps)))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# --- op6

def slow_hits(text, items, width=10):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    w = word.findall(lower(text))
    hit, who = set(), set()
    for item, t in items:
        b = word.findall(lower(t))
        for win in [b[i : i + width] for i in range(max(1, len(b) - width + 1))] if b else []:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    who.add(str(item))
    return len(w), hit, sorted(who)


@pytest.mark.parametrize("block", [1 << 20, 160])
def test_decontamination(spark, block):
    rng = np.random.default_rng(6)
    items = [(1, "a b"), (2, " ".join(rng.choice(WORDS, 14))), (10, "É x, Y"), (3, None), (4, "..."), (5, "a a"), (6, "a b")]
    texts = [*AWKWARD, "A, b a a a b", "É--X y " + items[1][1].upper() + " tail", " ".join(rng.choice(["a", "b"], 60)), "x " + " ".join(items[1][1].split()[2:13])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, texts)
    got = {r.doc_id: r for r in decontaminate.find_contamination(df, bench, block_bytes=block).collect()}
    for i, t in enumerate(texts):
        n, hit, who = slow_hits(t, items)
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (n, len(hit), who)
        covered = " ".join((t or "")[s.start : s.end] for s in got[i].spans)
        assert len(words_of(covered.encode())) == len(hit)
    kept = decontaminate.drop_contaminated(df, bench, block_bytes=block)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(texts) if not slow_hits(t, items)[1]]
    assert decontaminate.find_contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0


def test_many_blocks(spark):
    """A benchmark of over a hundred blocks: the same rows as with one."""
    rng = np.random.default_rng(16)
    bench = spark.createDataFrame([(k, " ".join(rng.choice(WORDS, 12))) for k in range(75)], "item_id long, text string")
    items = [tuple(r) for r in bench.collect()]
    df = docs(spark, ["x " + items[k][1] + " y " + items[k + 1][1] for k in range(0, 20, 2)] + ["nothing", None])
    assert decontaminate.window_table(bench, block_bytes=100)[1] > 100
    few, many = (sorted(map(str, decontaminate.find_contamination(df, bench, block_bytes=b).collect())) for b in (1 << 20, 100))
    assert few == many


# --- op1

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[ -]", "", m)) <= 19 and sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d[::-1])) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


@given(st.text(alphabet="ab@.-+ 0123456789()%_é", max_size=60))
@settings(max_examples=300, deadline=None)
def test_base_pii(text):
    want = {(m.start(), m.end(), k) for k, (rx, ok) in BASE.items() for m in re.finditer(rx, text) if ok(m[0])}
    assert set(pii.detect(text)) == want


@pytest.mark.parametrize(("text", "kind"), [
    ("host one nine two dot one six eight dot zero dot one up", "ip"),
    ("host one nine two.one six eight.zero.one up", "ip"),
    ("host one.one.one.one up", "ip"),
    ("host 192 dot one six eight dot 0 (dot) one up", "ip"),
    ("host 10.0.0.one up", "ip"),
    ("call +1 555 one two three 4567 now", "phone"),
    ("call +1 555 one 23 4567 now", "phone"),
    ("card four one one one one one one one one one one one one one one one now", "card"),
])
def test_short_spelled_runs(text, kind):
    base = pii.detect(text)
    (s, e, found), = pii.disguised(text, base)
    assert found == kind and (text[:s], text[e:]) == (text[: text.index(" ") + 1], text[text.rindex(" ") :]) and not base


@pytest.mark.parametrize("text", ["no one. two of us, three. four", "chapter one dot two", "one 2 three", "zone.one"])
def test_spelled_words_of_prose(text):
    assert pii.detect(text) == [] and pii.disguised(text, []) == []


def test_disguised_pii(spark):
    texts = ["write to jo (at) mail [dot] example [dot] com now", "jo at mail dot com", "call plus four four two zero seven nine four six zero nine five eight", "ip １０.0.0.１", "a​b@c.de", "meet at noon, polka dot dress", "jо@ехample.com"]
    spans = [pii.joined((b := pii.detect(t)) + pii.disguised(t, b)) for t in texts]
    assert spans[0] == "email:9:45" and texts[0][9:45] == "jo (at) mail [dot] example [dot] com"
    assert spans[1] == "email:0:18" and spans[2] == f"phone:5:{len(texts[2])}" and spans[3] == "ip:3:11"
    assert spans[4] == "email:0:8,email:2:8"  # what stands there already stays, beside the longer one
    assert spans[5] == "" and spans[6] == "email:0:14"
    rows = pii.find_pii(docs(spark, [*AWKWARD, "1" * 100_000, "+1 " * 30_000, "a@" * 30_000])).collect()
    assert len(rows) == len(AWKWARD) + 3
    assert pii.find_pii(docs(spark, []).limit(0)).count() == 0


SIGNS = [("@", "email"), (" [at] ", "email"), ("(ät)", "email"), ("＠", "email")]
ALIKE = {a: many for a, many in pii.LOOKALIKES.items() if a.isalpha()}
SPELLED = [["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"], ["null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"], ["zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"], ["cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"]]


def in_disguise(rng, plain, kind):
    """An identifier under one disguise, drawn without the operator's rules."""
    way = int(rng.integers(3))
    if way == 0:  # invisible characters
        for k in sorted(rng.choice(np.arange(1, len(plain)), 2, replace=False), reverse=True):
            plain = plain[:k] + str(rng.choice(list("\u200b\u00ad\u2060"))) + plain[k:]
        return plain
    if kind == "email":
        if way == 1:
            return plain.replace("@", str(rng.choice(["(at)", " [at] ", "＠", " {arroba} "]))).replace(".", str(rng.choice(["(dot)", " [punkt] ", "．"])))
        return "".join(str(rng.choice(list(ALIKE[c]))) if c in ALIKE and rng.random() < 0.4 else c for c in plain[:-1]).replace("@", "＠") + plain[-1]
    if way == 1:
        return "".join(chr(0xFF10 + int(c)) if c.isdigit() else c for c in plain)
    words = SPELLED[int(rng.integers(4))]
    return "".join(f" {words[int(c)]}" if c.isdigit() else " dot" if c == "." else "plus" if c == "+" else "" for c in plain).strip()


@pytest.mark.parametrize("kind", ["email", "ip", "card", "phone"])
def test_disguises_are_undone(kind):
    """Identifiers in disguise amid prose: the span found is the one that was put there."""
    rng = np.random.default_rng(len(kind))
    for _ in range(150):
        plain = {"email": f"jo{rng.integers(99)}ann@mail.example{rng.integers(9)}.org", "ip": ".".join(str(rng.integers(256)) for _ in range(4)), "card": "4111111111111111", "phone": "+44207946" + str(rng.integers(1000, 9999))}[kind]
        hidden = in_disguise(rng, plain, kind)
        before, after = "Wir lesen hier, ", " ; fin de la ligne"
        text = before + hidden + after
        base = pii.detect(text)
        want = (len(before), len(before) + len(hidden), kind)
        assert want in base + pii.disguised(text, base), (text, base, pii.disguised(text, base))


@pytest.mark.parametrize(("text", "span"), [
    ("bob@exam\u200bple.com", "email:0:16"),
    ("bob@mail.exаmple.com", "email:0:20,email:0:11"),
    ("call +44 two zero seven 946 zero nine five eight", "phone:5:48"),
    ("4111 1111\u200b 1111 1111", "card:0:20"),
    ("10.0\u200b.0.1", "ip:0:9"),
    ("mail bob@example.com\u200b now", "email:5:20"),
])
def test_probes(text, span):
    base = pii.detect(text)
    assert sorted(pii.joined(base + pii.disguised(text, base)).split(",")) == sorted(span.split(","))


# --- op2

PAGE = "<html><head><title>t</title></head><body><nav><a href=/>home</a></nav><div class='{}'>{}</div><div class=sidebar>links here</div><footer>foot</footer></body></html>"


def test_pages(spark):
    body = "<h1>Head &amp; line</h1><p>First  paragraph\n of text that is long enough.<p>Second&nbsp;one<script>var x='<p>no</p>'</script><br></p><ul><li>item<li>other</ul><div class='comments'><p>a reader says so</p></div>"
    text = "Head & line\nFirst paragraph of text that is long enough.\nSecond one\nitem\nother"
    rows = [(1, "http://h.example/a?1", PAGE.format("post-17", body)), (2, "http://h.example/b", PAGE.format("post-3", body)), (3, None, ""), (4, "http://h.example/c", None), (5, "junk", "just <b>text"), (2, "http://h.example/b", PAGE.format("post-3", body))]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == by[2].text == text and by[1].n_chars == len(text) and by[1].path.endswith("div.post-#")
    assert (by[3].text, by[4].text, by[5].text) == ("", "", "just text")
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_consensus_overrules_one_page():
    assert html_extract.extract(PAGE.format("entry", "<p>ok</p>").replace("links here", "x " * 40).replace("class=sidebar", "class=box"), ">html>body>div.entry")[0] == "ok"
    short = PAGE.format("entry", "<p>tiny text of the article, not long</p>").replace("links here", "x " * 40).replace("class=sidebar", "class=box")
    assert html_extract.extract(short, ">html>body>div.entry")[0] == "tiny text of the article, not long"


ARTICLE = "<html><body><div class=nav-bar>menu</div><article>{}</article></body></html>"


@pytest.mark.parametrize(("inside", "text"), [
    ("<p>" + "a < b " * 100 + "</p><p title=\"a > b\">after</p>", "a < b " * 99 + "a < b\nafter"),
    ("<div>" * 400 + "<p>deep text</p><nav>menu</nav><div class=comments>a reader</div>" + "</div>" * 400 + "<p>after</p>", "deep text\nafter"),
    ("<div class=article-header><h1>Title</h1></div><p>text</p>", "Title\ntext"),
    ("<p class='legal notice'>read this</p><div class=related-work>others did</div><p>text</p>", "read this\nothers did\ntext"),
    ("<p>text</p><div class=share-bar>share</div><div id=comments><p>reader</p></div><section class='related posts'>more</section>", "text"),
    ("<p title='it''s'>one</p><p title=it's>two</p><p alt=\"x>three</p>", "one\ntwo\nthree"),
    ("<p>one<!-- <p>not</p> -->, two<!DOCTYPE x> three</p>", "one, two three"),
])
def test_nothing_else_is_dropped(inside, text):
    assert html_extract.extract(ARTICLE.format(inside))[0] == text


def test_title_in_a_header():
    page = "<html><body><header><h1>Site</h1></header><div class=entry><header><h1>Title</h1></header><p>" + "text " * 40 + "</p></div></body></html>"
    assert html_extract.extract(page)[0].startswith("Title\ntext")
    assert "Site" not in html_extract.extract(page)[0]


def test_votes(spark):
    """Votes counted in Spark are those of a plain count, ties go to the path that sorts first; columns with clashing names."""
    one, other = "<div class=b-{}><p>" + "text " * 30 + "</p></div>", "<div class=a-{}><p>" + "words " * 30 + "</p></div>"
    kinds = {"x.example": [one, one, other, other, one + other], "y.example": [one, other, other], "": [other]}
    rows = [(100 * h + i, f"http://{host}/p{i}" if host else None, "<html><body>" + k.format(i, i) + "</body></html>", "h", "w", "p", 1, "t") for h, (host, pages) in enumerate(kinds.items()) for i, k in enumerate(pages)]
    rows.append((900, "http://z.example/", "<html><body><div class=b-1><p>" + "long text " * 200_000 + "</p></div></body></html>", "", "", "", 0, ""))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, winner string, path string, votes int, vote_host string").repartition(4)
    want = defaultdict(int)
    for r in rows:
        want[html_extract.host_of(r[1] or ""), html_extract.extract(r[2])[1]] += 1
    assert {(r.host, r.path): r.votes for r in html_extract.votes(df).collect()} == dict(want)
    winners = {}
    for (host, path), n in sorted(want.items(), key=lambda x: (-x[1], x[0][1])):
        winners.setdefault(host, path)
    got = {r.page_id: r for r in html_extract.extract_pages(df).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert (got[r[0]].text, got[r[0]].path) == html_extract.extract(r[2], winners[html_extract.host_of(r[1] or "")])
    assert got[900].n_chars == 10 * 200_000 - 1 and got[4].path == winners["x.example"]


@given(st.text(alphabet="<>ab=\"'/ -!", max_size=40))
@settings(max_examples=500, deadline=None)
def test_tokens_cover_the_page(page):
    """Every character is in one token; a tag ends at the first ``>`` outside closed quotes of its values."""
    at = 0
    for kind, tag, rest in html_extract.tokens(page):
        if kind:
            at = page.lower().index(kind + tag, at)
            bare = re.sub("=\\s*(\"[^\"]*\"|'[^']*')", lambda m: "=" + "_" * (len(m[0]) - 1), page[at + len(kind + tag) :])
            assert bare.index(">") == len(rest) and page[at + len(kind + tag) :].startswith(rest)
            at += len(kind + tag + rest) + 1
        else:
            at = page.index(rest, at) + len(rest)


def test_hostile_pages_are_linear():
    for page in ("<a b='" * 20_000 + ">", "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<b>" * 20_000 + "<p>" * 20_000, "<p a='x\">" * 20_000,"<" * 50_000, "<div>" * 20_000 + "x", '<a b="' * 20_000, "<b>" * 20_000 + "</i>" * 20_000):
        html_extract.extract(page)


# --- op8

def test_token_counts(spark, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*AWKWARD, "a  b ", "<s> x </s>", "▁a ▁", "  lead", "the " * 5000]
    df = docs(spark, texts)
    cache = str(tmp_path / "cache")
    for n_new in (len({t or "" for t in texts}), 0, 1):
        before = spark.read.parquet(cache).count() if (tmp_path / "cache").exists() else 0
        rows = {r.doc_id: r for r in token_counts.token_counts(df, path, cache).collect()}
        assert spark.read.parquet(cache).count() - before == n_new
        for i, t in enumerate(texts):
            n = len(model.encode(t or ""))
            assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), n, n > 4096)
        texts = [*texts, "fresh"] if n_new == 0 else texts
        df = docs(spark, texts)
    assert token_counts.token_counts(df.limit(0), path).count() == 0


@given(st.text(alphabet=" aé日▁<s>\n\t🙂", max_size=30))
@settings(max_examples=200, deadline=None)
def test_words_count_as_texts(text):
    c = test_words_count_as_texts.c = getattr(test_words_count_as_texts, "c", None) or token_counts.Counter(Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes())
    assert c.by_word and c.count(text) == len(c.model.encode(text))


# --- op9

def test_licenses(spark):
    texts = [*AWKWARD, "x CC-BY y cc by. CC BY CC by", "The GNU General Public License!", "All rights reserved.\nReleased under the MIT License.", "permission is hereby granted to any person obtaining a copy of this software and associated documentation files free of charge now", "Licensed under CC BY-NC 4.0."]
    df = docs(spark, texts)
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        w = words_of((t or "").encode())
        found = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.encode().split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(r.labels.split(",")) >= {x for _, x in found} | {""} - ({""} if r.labels else set()) and 0 <= r.score <= 1
    assert got[len(texts) - 1].labels == "cc-by-nc" if "cc by" not in " ".join(licenses.PHRASES) else "cc-by,cc-by-nc"
    assert licenses.scan_licenses(df.limit(0)).count() == 0


# --- op4

def test_toxicity(spark):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        w = [f"{a}{b}" for a, b in zip(rng.choice(["ta", "re", "no", "li"], 60), rng.choice(["mo", "sa", "ku", "ven"], 60))]
        if toxic:
            for k in rng.choice(60, 6, replace=False):
                w[k] = "grox" + str(rng.choice(["il", "en", "ad"]))
        rows.append(" ".join(w))
        labels.append((i, int(toxic)))
    df = docs(spark, [*rows, None, "", "GROXIL " * 50, "groxen"], [*range(600), 900, 901, 902, 902])
    model = toxicity.fit(df, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    out = toxicity.score_toxicity(df, model).collect()
    assert len(out) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    by = {r.doc_id: r for r in out}
    held = [(by[i].predicted, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p == y for p, y in held]) > 0.97 and all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    assert by[900].predicted == by[901].predicted == 0
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in out)
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0
    assert toxicity.drop_toxic(df.limit(0), model).count() == 0
    odd = docs(spark, [*AWKWARD, "groxil " * 40, "groxil " * 40], [None, *range(len(AWKWARD) - 1), 70, 70])
    some = toxicity.score_toxicity(odd, model).collect()
    assert len(some) == len(AWKWARD) + 2 and all(0 <= r.score <= 1 for r in some) and [r.predicted for r in some if r.doc_id == 70] == [1, 1]
    assert sorted(r.doc_id or -1 for r in toxicity.drop_toxic(odd, model).collect()) == sorted(r.doc_id or -1 for r in some if not r.predicted)
    nothing = toxicity.fit(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 <= nothing.score(b"any text") <= 1


def test_backoff_counts_are_one_small_plan(spark):
    """All lengths in one plan: a plan a length, each made of the one before, took the driver more memory than its limit."""
    rows = spark.createDataFrame([("\x02on", 2, 1, 1), ("\x02one", 1, 0, 1)], "key string, n long, n0 long, n1 long")
    found = toxicity.backoff_rows(rows, rows.where("n1 > 0"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 12


def test_kneser_ney_against_brute_force(spark):
    """The log-ratios against the formulas over all substrings of all words."""
    rng = np.random.default_rng(12)
    texts = [" ".join("".join(rng.choice(list("abcé"), rng.integers(1, 8))) for _ in range(rng.integers(1, 12))) for _ in range(40)]
    of = {i: i % 2 for i in range(24)}  # the others have no class, but count for the shared model
    rows = toxicity.corpus_grams(docs(spark, [*texts, None, ""]), spark.createDataFrame(list(of.items()), "id long, toxic int"))
    seen = rows.where("n0 + n1 > 0")
    found = toxicity.backoff_rows(rows, seen).collect()
    assert len({r.gram for r in found}) == len(found)
    model = toxicity.kneser_ney([(r.key, r.n0, r.n1) for r in seen.collect()], {r.gram: (r.left, r.total, r.types) for r in found})

    own, parts = [defaultdict(int), defaultdict(int)], set()
    for i, text in enumerate(texts):
        for w in set(text.split()):
            s = toxicity.START + w + toxicity.END
            parts |= {s[a:b] for a in range(len(s)) for b in range(a + 1, min(len(s), a + toxicity.ORDER) + 1)}
            if i in of:
                for g in (s[max(0, j + 1 - toxicity.ORDER) : j + 1] for j in range(1, len(s))):
                    own[of[i]][g] += 1
    left = defaultdict(int)
    for g in parts:
        left[g[1:]] += 1

    def share(g):
        if not g:
            return 1 / 256
        after = [n for x, n in left.items() if x and x[:-1] == g[:-1] and len(x) == len(g)]
        return (max(left[g] - 0.75, 0) + 0.75 * len(after) * share(g[1:])) / sum(after) if after else share(g[1:])

    def likelihood(counts, g):
        after = [n for x, n in counts.items() if x[:-1] == g[:-1]]
        return (max(counts.get(g, 0) - 0.75, 0) + 0.75 * len(after) * share(g[1:])) / sum(after) if after else share(g[1:])

    assert set(model.ratio) == set(own[0]) | set(own[1])
    for g, r in model.ratio.items():
        assert r == pytest.approx(np.log(likelihood(own[1], g) / likelihood(own[0], g)))


@given(st.lists(st.sampled_from("released under the mit bsd license licensed cc by nc 4 0 and x y z".split()), max_size=40), st.sampled_from([0.6, 0.8, 1.0]))
@settings(max_examples=300, deadline=None)
def test_license_join(words, threshold):
    """Places are found for a template if and only if a window holds enough of it, with its telling words."""
    templates = {"mit": ("Released under the MIT License.",), "bsd": ("Released under the BSD License.",), "cc-by": ("Licensed under CC BY 4.0.",), "cc-by-nc": ("Licensed under CC BY-NC 4.0.",)}
    index = licenses.Index({b"the": 9, b"under": 5}, templates, threshold)
    raw = [w.encode() for w in words]
    there = [(i, w) for i, w in enumerate(raw) if w in index.every]
    for k, (_, own, need) in enumerate(index.templates):
        windows = [set(raw[i : i + index.spans[k]]) for i in range(len(raw))]
        want = any(len(w & set(own)) >= max(need, threshold * len(own) - 1e-9) and index.telling[k] <= w for w in windows)
        found = list(index.places(k, there)) if k in index.candidates(there) else []
        assert bool(found) == want
        for s, e, common, _ in found:
            assert e - s <= index.spans[k] and len(set(raw[s:e]) & set(own)) == common


@pytest.mark.parametrize(("text", "labels"), [
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("we all have rights reserved", ""),
    ("Released under the BSD License.", "bsd"),
    ("Released under the new License.", ""),
    ("the license under which this was released", ""),
])
def test_license_names(text, labels):
    assert ",".join(sorted(licenses.scan(text.encode(), licenses.Index({}))[3])) == labels


def test_wrapped_licenses():
    index = licenses.Index({})
    mit = b"Copyright (c) 2020 Somebody\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction\n"
    bsd = b"Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the following conditions\r\nare met:\r\n"
    assert licenses.scan(mit, index)[3] == {"mit"} and licenses.scan(mit, index)[4] == 1.0
    assert licenses.scan(bsd, index)[3] == {"bsd"} and licenses.scan(bsd, index)[4] == 1.0
    apart = bsd.replace(b"without\r\n", b"without\r\n\r\n")
    assert not licenses.scan(apart, index)[3]  # an empty line ends a paragraph
    far = b" ".join(w + b" x y z" + (b"\n" if i % 5 == 0 else b"") for i, w in enumerate(bsd.split()))
    assert not licenses.scan(far, index)[3]  # the same words, but not within a window


def test_repeated_rows_and_null_ids(spark):
    """Every row is a row of the result, also where it repeats another or has no id."""
    texts = [prose(40, 80), prose(40, 80), None, "all rights reserved", prose(41, 60) + " " + prose(40, 80)]
    df = docs(spark, texts, [1, 1, 1, None, 5])
    bench = spark.createDataFrame([(1, prose(40, 80))], "item_id long, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = toxicity.Model({}, {}, (-1.0, 1.0, 0.0, 0.0))
    for out in (pii.find_pii(df), decontaminate.find_contamination(df, bench), licenses.scan_licenses(df), token_counts.token_counts(df, path), simhash.near_duplicates(df), exact_dedup.exact_duplicates(df), toxicity.score_toxicity(df, model)):
        assert sorted(r.doc_id or -1 for r in out.collect()) == [-1, 1, 1, 1, 5]
    rows = substring_dedup.repeated_passages(df).collect()
    assert {(r.doc_id, r.other_id, r.start_word, r.end_word) for r in rows} == {(5, 1, 60, 140)}
    assert mixing.mix(df).where("doc_id = 1").count() <= 3


# --- op3

def slow_budgets(leaves, total, weights):
    """Level by level, by repeated sharing among children that are not full."""
    def deal(budget, children):
        got, open_ = dict.fromkeys(children, 0), set(children)
        while open_:
            left = budget - sum(got[c] for c in children if c not in open_)
            w = sum(children[c][1] for c in open_)
            full = {c for c in open_ if children[c][0] * w <= left * children[c][1]}
            if not full:
                for c in open_:
                    got[c] = left * children[c][1] // w
                break
            for c in full:
                got[c] = children[c][0]
            open_ -= full
        return got

    out, nodes = {}, {(): min(total, sum(leaves.values()))}
    for level in range(3):
        nxt = {}
        for path, budget in nodes.items():
            children = defaultdict(int)
            for leaf, cap in leaves.items():
                if leaf[:level] == path:
                    children[leaf[level]] += cap
            shares = deal(budget, {c: (cap, weights[mixing.LEVELS[level]].get(c, mixing.DEFAULT_WEIGHT)) for c, cap in children.items()})
            nxt |= {(*path, c): b for c, b in shares.items()}
        nodes = nxt
    return nodes | out


@pytest.mark.parametrize("scale", [1, 10**12 + 7])
def test_leaf_budgets(spark, scale):
    """Also where numbers times weights are beyond what a double holds exactly."""
    supplies = {("web", "en", "s1"): 100, ("web", "en", "s2"): 3, ("web", "de", "s1"): 10, ("forum", "en", "s3"): 1000, ("forum", "fr", "s3"): 7, ("other", "es", "s9"): 0}
    supplies = {k: v * scale for k, v in supplies.items()}
    leaves = spark.createDataFrame([(*k, v) for k, v in supplies.items()], "domain string, lang string, source string, supply long")
    for total in (0, 50, 500, 2000, 10**6, 77 * scale + 1, 500 * scale + 3, 2000 * scale):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(leaves, total, max_epochs=2).collect()}
        want = slow_budgets({k: v * 2 for k, v in supplies.items()}, total, mixing.WEIGHTS)
        assert got == want
        assert sum(got.values()) <= total


def test_mix(spark):
    texts = [prose(50 + i, 5 + i) for i in range(60)]
    df = docs(spark, [*texts, None, ""], lang=None)
    rows = mixing.mix(df).collect()
    total = sum(5 + i for i in range(60))
    spent = sum(r.n_copies * r.n_tokens for r in rows)
    assert total * 0.6 - 65 <= spent <= total * 0.6 and {r.lang for r in rows} == {"unknown"}
    assert rows == mixing.mix(df).collect() or sorted(rows) == sorted(mixing.mix(df).collect())
    assert mixing.mix(df.limit(0)).count() == 0


# --- queries

@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    from tests.test_entry import same_rows

    same_rows(spark, QUERIES, ORACLES, name)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontaminate", "mixing"]
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    clean = {r.doc_id: r for r in corpus_pipeline.STAGES[0][1](spark, documents, str(DATA)).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert 0.6 * documents.count() < len(clean) < documents.count() and sum(labels.get(i, 0) for i in clean) <= 0.4 * sum(labels.values())
    last = {}
    for i in sorted(clean):
        last[clean[i].text or ""] = i
    ids = sorted(last.values())
    ids = [i for i, c in zip(ids, classes([slow_fingerprint(clean[i].text) for i in ids]), strict=True) if ids[c] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    windows = {w for _, t in items for w in decontaminate.windows(t.encode())}
    ids = [i for i in ids if not windows & decontaminate.windows((clean[i].text or "").encode())]
    con = duckdb.connect()
    con.execute("CREATE TABLE rest (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO rest VALUES (?, ?, ?, ?)", [(i, clean[i].text, clean[i].lang, clean[i].source) for i in ids])
    want = sorted(con.execute(mixing_sql("rest")).fetchall())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(DATA)).collect()) == want


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def piped(spark, at, rows, labels=(), items=(), schema=DOCUMENTS):
    """Rows of the pipeline over tables with these rows, and of each stage's predecessor's schema as it reaches mixing."""
    import corpus_pipeline

    spark.createDataFrame(list(rows), schema).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, toxic int, lang string").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(at))


def test_pipeline_of_empty_tables(spark, tmp_path):
    out = piped(spark, tmp_path, [])
    assert out.columns == ["doc_id", "domain", "lang", "source", "n_tokens", "n_copies"] and not out.collect()


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, copies, repeated rows and clashing names, with labels of one class only: nothing tells
    what is toxic, so what stays follows from the plain rules of the other stages."""
    extra = "toxic int, digest string, fp long, keep_id long, score double, id string, root long, window string"
    leak = prose(5, 14)
    texts = [*AWKWARD, leak + " " + prose(6, 40), prose(7, 30), prose(7, 30)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"src{i}", None, None, None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    rows += [rows[-1], (None, prose(8, 30), None, None, *[None] * 9)]
    out = piped(spark, tmp_path, rows, [(i, 0, None) for i in range(len(texts))] + [(None, None, None)], [(1, leak), (2, None), (3, "")], f"{DOCUMENTS}, {extra}")
    got = out.collect()
    last = {}
    for i, t in enumerate(texts):
        last[t or ""] = i
    ids = sorted(last.values())
    ids = [i for i, c in zip(ids, classes([slow_fingerprint(texts[i]) for i in ids]), strict=True) if ids[c] == i and not (texts[i] or "").startswith(leak)]
    left = [(i, texts[i], rows[i][2], rows[i][3]) for i in ids] + [(None, prose(8, 30), None, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE rest (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO rest VALUES (?, ?, ?, ?)", left)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(mixing_sql("rest")).fetchall()))
