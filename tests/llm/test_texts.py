"""Operators on single texts against plain versions: URL filter, language, personal data, fingerprints, HTML, tokens."""

import hashlib
import html
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from webloom.llm import bpe, decontaminate, fingerprints, html_text, language_id, pii, textvec, token_counts, url_filter
from webloom.llm.textvec import utf8

WORDS = "the of and to a in that is was he for it with as his on be at by i this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_url_parts_and_rules(spark):
    urls = [None, "", "nourl", "HTTP://WWW.Example.COM/en/7?x#y", "http://example.com/en/8", "http://xcom/en/", "x://example.net/de/8", "http://a.example.net/de/7", "http://org/es/1", "http://a.org#z/es/", "http://h?p/en/", "a://b://c/d"]
    model = url_filter.train(url_filter.labelled(spark))
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, host string").select("page_id", "url")
    got = {r["page_id"]: r for r in url_filter.judge(df, model).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest, maxsplit=1)[0]
            path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
            host = host.translate(low)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert got[i]["rule"] == (max(fits)[1] if fits else None)
        if fits:
            assert got[i]["verdict"] == max(fits)[2]
        if not host and not path:
            assert got[i]["verdict"] == "allow"


def test_url_model_on_unseen_sites(spark):
    model = url_filter.train(url_filter.labelled(spark))
    mark = lambda h, p: f"<{h}>({p})"
    bad = [mark(h, "/x") for h in ("casino-royal.example.info", "www.best-pills.example.co", "spamfarm.example.dev", "adult-cams.example.app", "freebets.example.biz")]
    good = [mark(h, "/x") for h in ("river-walks.example.info", "www.old-library.example.co", "chess-club.example.dev", "gardens.example.app", "statistics.example.biz")]
    assert (model.score(pa.array(bad)) > url_filter.THRESHOLD).mean() >= 0.8
    assert (model.score(pa.array(good)) < url_filter.THRESHOLD).mean() >= 0.8


def test_url_model_held_out_sites(spark):
    """Names whose labelled sites the model has not seen: few good ones are blocked, most bad ones are."""
    rows = sorted((r["url"], r["blocked"]) for r in url_filter.labelled(spark).collect())
    name = lambda u: re.sub(r"^(www|blog|m)\.", "", u.split("://", 1)[-1]).split(".")[0]
    names = sorted({name(u) for u, _ in rows})
    random.Random(31).shuffle(names)
    blocked = {0: [], 1: []}
    for k in range(3):
        out = set(names[k::3])
        model = url_filter.train(spark.createDataFrame([r for r in rows if name(r[0]) not in out], "url string, blocked int"))
        rest = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows) if name(u) in out], "page_id int, url string, label int")
        for r in url_filter.judge(rest.select("page_id", "url"), model).join(rest.select("page_id", "label"), "page_id").where("rule IS NULL").collect():
            blocked[r["label"]].append(r["verdict"] == "block")
    wrong, right = (sum(blocked[y]) / len(blocked[y]) for y in (0, 1))
    print(f"held out: {wrong:.3f} of {len(blocked[0])} good URLs blocked, {right:.3f} of {len(blocked[1])} bad ones")
    assert wrong <= 0.05 and right >= 0.35  # measured: 0.027 and 0.411


def test_url_empty_table_and_very_long_urls(spark):
    model = url_filter.train(url_filter.labelled(spark))
    df = spark.createDataFrame([(1, "http://example.com/en/7" + "/x" * 200_000), (2, "http://h/" + "é" * 100_000), (2, "http://h/" + "é" * 100_000)], "page_id int, url string")
    got = url_filter.judge(df, model).collect()
    assert len(got) == 3 and {r["verdict"] for r in got if r["page_id"] == 1} == {"allow"} and url_filter.judge(df.limit(0), model).count() == 0


def test_suffix_automaton_knows_exactly_the_substrings():
    rng = random.Random(4)
    codes = [rng.randrange(3, 6) for _ in range(40)]
    table = language_id.suffix_automaton(codes, 7)
    known = {tuple(codes[i:j]) for i in range(41) for j in range(i + 1, 41)}
    for _ in range(3000):
        word = tuple(rng.randrange(3, 6) for _ in range(rng.randrange(1, 9)))
        state = 0
        for c in word:
            state = table[state, c] if state >= 0 else -1
        assert (state >= 0) == (word in known)


@pytest.mark.parametrize("window", [4, 256])
def test_phrases_equal_greedy_parsing(monkeypatch, window):
    """Whole texts are parsed from start to end, however long their windows are."""
    monkeypatch.setattr(language_id, "WINDOW", window)
    sources = (["the cat sat on the mat"], ["un chat sur le tapis, ж"])
    model = language_id.Model({"a": sources[0], "b": sources[1]})
    rng = random.Random(5)
    for texts in [["", "12 !", "the mat, the CAT!", "xyz"], ["".join(rng.choice("thecatonm  ,.éжqЖ") for _ in range(n)) for n in (7, 90, 255, 256, 257, 0, 900, 513)]]:
        codes, letters = model.encode(texts)
        made, n, count = model.phrases(texts)
        assert n.tolist() == [len(c) for c in codes] and count.tolist() == letters.tolist() == [sum(map(str.isalpha, t)) for t in texts]
        for k, source in enumerate(sources):
            known, _ = model.encode(source)
            whole = bytes([*known[0].tolist(), language_id.SPACE])
            for text, code, got in zip(texts, codes, made[k].tolist()):
                w, i, phrases = bytes(code.tolist()), 0, 0
                while i < len(w):
                    j = i + 1
                    while j < len(w) and w[i : j + 1] in whole and w[i : i + 1] in whole:
                        j += 1
                    i, phrases = j, phrases + 1
                assert got == phrases, text


def test_packed_steps_are_those_of_the_table():
    rng = random.Random(29)
    for symbols in (3, 9, 60):
        table = language_id.suffix_automaton([rng.randrange(1, symbols) for _ in range(1500)], symbols)
        cells, root = language_id.packed(table)
        base = {0: 0}
        todo = [0]
        while todo:
            s = todo.pop()
            for c in range(symbols):
                cell = int(cells[base[s] + c])
                assert (cell >> 32 == base[s]) == (table[s, c] >= 0)
                if table[s, c] >= 0 and int(table[s, c]) not in base:
                    base[int(table[s, c])] = cell & 0xFFFFFFFF
                    todo.append(int(table[s, c]))
        assert len(set(base.values())) == len(table) and [c >= 0 for c in root] == [x >= 0 for x in table[0]]
        assert len(cells) < 3 * (table >= 0).sum() + 2000


def test_every_label_and_script_is_learned(spark):
    """More labels than any fixed number of them, in scripts of their own, among them one with thousands of letters."""
    rng = random.Random(30)
    scripts = {"ru": range(0x430, 0x450), "el": range(0x3B1, 0x3CA), "he": range(0x5D0, 0x5EB), "zh": range(0x4E00, 0x5800), "ko": range(0xAC00, 0xB000)} | {f"l{k}": [ord(c) for c in rng.sample("abcdefghijklmnopqrstuvwxyz", 5)] for k in range(75)}
    words = {lang: ["".join(chr(rng.choice(of)) for _ in range(5)) for _ in range(12)] for lang, of in scripts.items()}
    rows = [(i, " ".join(rng.choices(words[lang], k=40)), lang) for i, lang in enumerate(list(scripts) * 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(docs)
    assert set(model.languages) == set(scripts)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs.drop("lang"), model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_language_held_out_accuracy_and_no_leak(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = language_id.query(spark, data).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark, odd, empty):
    model = language_id.Model({"en": ["plain words of english text"], "fr": ["des mots en français"]})
    got = language_id.predict(odd, model).collect()
    assert len(got) == 10
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert language_id.predict(empty, model).count() == 0
    assert language_id.train(empty).languages == [] and language_id.train(odd.withColumn("lang", odd["lang"].substr(9, 1))).languages in ([], [""])
    assert language_id.predict(odd, language_id.Model({})).where("lang_pred = 'und'").count() == 10


def naive_spans(text):
    out = []
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (14 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@-+ ()%_b23é,") for _ in range(rng.randrange(45)))
        assert pii.base_spans(text) == naive_spans(text), text
    card = "4111 1111 1111 1111"
    assert pii.base_spans(f"x {card} y") == [(2, 2, 2 + len(card))]
    for evil in ("1" * 200_000, "@" * 100_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 100_000):
        pii.base_spans(evil)  # linear, or this never ends


def test_field_adds_a_mention_that_its_other_place_explains():
    finder = pii.Finder()
    text = "Call +1 (988) 555-2485 now, not on page 12 of 2024. Later only 555-2485 works, or bob.smith42 of bob.smith42@mail.com"
    base, every = finder.spans([text])[0]
    assert base == pii.base_spans(text) and set(base) <= set(every)
    assert {text[a:b] for a, _, b in set(every) - set(base)} >= {"555-2485"}
    assert finder.spans(["version 3.10 of 12 pages in 1999"])[0] == ([], [])


def digit_runs(text):
    return {(m.start(), m.end()) for m in re.finditer(r"(?<![0-9])[0-9]{16}(?![0-9])", text)}


def hex_tokens(text):
    return {m.span(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', text)}


def test_the_field_adds_what_is_planted_in_documents_and_nothing_else(data):
    """Precision of the added spans, and recall of documents that hold a base span, a number of 16 digits or a token."""
    texts = [r["text"] or "" for r in pq.read_table(f"{data}/documents.parquet").to_pylist()]
    made = right = caught = planted = 0
    for text, (base, every, secrets) in zip(texts, pii.Finder().found(texts)):
        added = {(a, b) for a, _, b in set(every) - set(base)} | {(a, b) for a, _, b in secrets}
        truth = digit_runs(text) | hex_tokens(text)
        made, right = made + len(added), right + len(added & truth)
        if base or truth:
            planted += 1
            caught += bool(every or secrets)
        else:
            assert not every and not secrets
    assert right > 0 and right >= 0.95 * made and caught >= 0.98 * planted > 0


def test_secrets_are_known_again_where_they_are_bare():
    value = "bee4a2827eb113d73cb298acc0f727ef99bdc461"
    finder = pii.Finder()
    (_, every, secrets), (_, _, bare) = finder.found([f"token = \"{value}\" is old. " + "word " * 500 + f"so {value}!! goes", f"commit {value} of main"])
    text = f"token = \"{value}\" is old. " + "word " * 500 + f"so {value}!! goes"
    assert every == [] and [text[a:b] for a, _, b in secrets] == [value, value] and bare == []


def test_windows_of_long_texts_agree_with_the_whole(monkeypatch):
    rng, finder = random.Random(27), pii.Finder()
    parts = []
    for k in range(400):
        a, b = rng.randrange(100, 1000), rng.randrange(1000, 10_000)
        parts += [prose(rng, 9), rng.choice([f"+1 ({a}) 555-{b}", f"mail{k}.x@mail.example.com", f"{rng.randrange(10**15, 10**16)}", f"{a}", f'token = "{rng.getrandbits(160):040x}"', f"555-{b}"])]
    text = prose(rng, 40).join([" +1 (988) 555-2485 ", " ".join(parts), " only 555-2485 works "])
    whole = finder.found([text])[0]
    monkeypatch.setattr(pii, "WINDOW", 1500)
    cut = finder.found([text])[0]
    assert cut[0] == whole[0] == pii.base_spans(text)
    found = [set(x[1]) | set(x[2]) for x in (whole, cut)]
    assert len(found[0] ^ found[1]) <= 0.02 * len(found[0])
    assert "555-2485" in {text[a:b] for a, _, b in set(cut[1]) - set(cut[0])}


def test_long_texts_of_numbers_need_bounded_memory():
    code = """
import random, resource
from webloom.llm import pii
rng = random.Random(1)
finder = pii.Finder()
texts = [" ".join(str(rng.randrange(10**n)) for _ in range(5_000_000 // (n + 1))) for n in (3, 6)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for text in texts:
    finder.found([text])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 400


def test_personal_data_odd_rows(spark, odd, empty):
    got = pii.find(odd).collect()
    assert len(got) == 10 and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == "" for r in got)
    assert pii.find(empty).count() == 0


def test_fingerprints_follow_the_edit(spark):
    rng = random.Random(7)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    vocab = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 12))) for _ in range(5000)]
    texts = [" ".join(rng.choices(vocab, k=rng.randrange(30, 200))) for _ in range(60)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(500, texts[0]), (501, None), (502, "é漢😀" * 5)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in fingerprints.compare_with_edits(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(t)
    assert got[0]["fingerprint"] == got[500]["fingerprint"]
    assert got[501]["fingerprint"] == "0" * 64
    many = [got[i] for i in range(0, 180, 3)]
    assert sum(r["near_edited"] > r["near_next"] for r in many) / len(many) > 0.95


def test_fingerprint_next_with_ties_and_one_row(spark, odd, empty):
    got = fingerprints.compare_with_edits(odd).collect()
    assert len(got) == 10
    order = sorted([(r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()], key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1].encode()))
    want = sorted(hashlib.sha256(fingerprints.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest() for k, (_, t) in enumerate(order))
    assert sorted(r["edited_sha256"] for r in got) == want
    assert fingerprints.compare_with_edits(empty).count() == 0
    one = fingerprints.compare_with_edits(spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")).collect()[0]
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(256) for _ in range(20)]
    near = [b ^ sum(1 << p for p in rng.sample(range(256), rng.randrange(0, 9))) for b in base for _ in range(5)]
    hexes = sorted({f"{x:064x}" for x in base + near})
    df = spark.createDataFrame([(h,) for h in hexes], "fingerprint string")
    got = {(r["asked"], r["stored"], r["distance"]) for r in fingerprints.within_radius(df, df).collect()}
    want = {(a, b, d) for a in hexes for b in hexes if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 6}
    assert got == want


def test_block_tables_with_nulls_repeats_and_no_rows(spark):
    zero, one = "0" * 64, "1" + "0" * 63
    df = spark.createDataFrame([(zero,), (zero,), (None,), (one,)], "fingerprint string")
    got = sorted((r["asked"], r["stored"], r["distance"]) for r in fingerprints.within_radius(df, df).collect())
    assert got == [(zero, zero, 0), (zero, one, 1), (one, zero, 1), (one, one, 0)]
    assert fingerprints.within_radius(df.limit(0), df).count() == 0 and fingerprints.within_radius(df, df.limit(0)).count() == 0


def test_all_fingerprints_of_the_documents_are_searched(spark, data):
    """The search over the whole table, copies and all, against every pair of distinct fingerprints."""
    found = fingerprints.fingerprint_column(spark.read.parquet(f"{data}/documents.parquet"))
    hexes = sorted({r["fingerprint"] for r in found.collect()})
    got = {(r["asked"], r["stored"]) for r in fingerprints.within_radius(found, found).collect()}
    numbers = [int(h, 16) for h in hexes]
    assert got == {(a, b) for a, x in zip(hexes, numbers) for b, y in zip(hexes, numbers) if (x ^ y).bit_count() <= 6}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><p>Site</p></header><nav><ul><li><a href=/a>A</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy now</div><article class="post"><div class="post-header"><h1>Head &amp;amp; line</h1></div><p>One <b>bold</b>
 word.<p>Two&nbsp;&eacute;<br>three<script>if (a < b) x("</p>");</script><aside>See also</aside><p>Four.</article>
<form><p>Your mail</p></form><section id="comments"><p>Nice post</p></section><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [(PAGE, "Head &amp; line\nOne bold word.\nTwo é three\nFour."), ("", ""), ("plain", "plain"), ("<p>a<p>b &lt;i&gt; <i>x</i>y", "a\nb <i> xy"), ("<p>cut &am", "cut &am"), ("<!-- a <p>b", ""), ("<script>never ends <p>x", ""), ("<p>2 < 3 and 4 > 1</p>", "2 < 3 and 4 > 1"), ("<div id='sidebar'><p>x</p></div><p>Some text here</p>", "Some text here"), ("<nav>only</nav>", "")],
)
def test_article(page, text):
    assert html_text.article(page) == text


@pytest.mark.parametrize("tag", ["article", "main", "div", "section", "td"])
def test_article_cut_up_by_adverts_stays_whole(tag):
    rng = random.Random(16)
    paragraphs = [prose(rng, n) for n in (90, 120, 80, 12)]
    adverts = "<div class=ad><p>Buy now</p></div>" * 3
    page = f"<body><ul class=menu><li>Home</ul>{adverts}<p>Log in</p>{adverts}<{tag}>" + adverts.join(f"<p>{p}</p>" for p in paragraphs) + f"</{tag}>{adverts}<div><p>Powered by us</p></div></body>"
    assert html_text.article(page) == "\n".join(paragraphs)


@pytest.mark.parametrize("n", [10, 399, 400, 5000])
def test_end_tags_close_at_any_depth(n):
    for name, mark in (("nav", ""), ("aside", ""), ("form", ""), ("div", " class=menu")):
        page = f"<{name}{mark}>" + "<ul>x" * n + f"</{name}><div><p>The article</p></div>"
        assert html_text.article(page) == "The article"


def plain_article(page):
    """The kept lines by loops: every window is summed anew, and a state goes from surge to dive."""
    lines = html_text.Lines(page)
    n = len(lines.text)
    weight, threshold = html_text.weights(lines)
    out, inside = [], False
    for i in range(n):
        ahead, behind = (sum(weight[j] for j in range(n) if 0 <= d * (j - i) < html_text.WINDOW) for d in (1, -1))
        surge = min(ahead, behind) >= threshold - 1e-6
        if not inside and surge:
            inside = True
        elif inside and not surge:
            inside = False
        if inside:
            out.append(lines.text[i])
    return "\n".join(out)


def marked_article(page):
    """Headings and paragraphs inside <article> of the given pages, which have no other blocks there."""
    body = page.split("<article>")[1].split("</article>")[0]
    blocks = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", body.replace("<br>", " ")))
    return "\n".join(x for b in blocks if (x := " ".join(html.unescape(b).split())))


def test_the_distribution_equals_brute_force_and_the_given_articles(data):
    pages = [r["html"] for r in pq.read_table(f"{data}/pages.parquet").to_pylist()]
    assert all(html_text.article(p) == plain_article(p) == marked_article(p) for p in pages)
    rng = random.Random(24)
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 25)):
            text = prose(rng, rng.choice([1, 2, 5, 30, 90]))
            parts.append(rng.choice(["<p>{}</p>", "{}<hr>", "<div>{}</div>", "<div><div>{}<p>{}</div></div>", "<a href=x>{}</a><hr>", "<ul><li>{}</ul>", "<article>{}</article>", "<h2>{}</h2>", "<div class=ad>{}</div>", "<section><p>{}"]).format(text, text))
        page = "".join(parts)
        assert html_text.article(page) == plain_article(page)


def test_the_distribution_decides(monkeypatch):
    rng = random.Random(25)
    long, short = [prose(rng, 80) for _ in range(4)], "Just so."
    loose = "<div>Home</div><div>Log in</div>" + "".join(f"<div>{t}</div>" for t in long[:2]) + "<div>Share</div><div>Print</div>" + "".join(f"<div>{t}</div>" for t in long[2:]) + "<div>Up</div><div>Powered by us</div>"
    marked = f"<p>Teaser</p><article><h1>Head</h1><p>{short}</p></article><div>{long[0] * 9}</div><div>Up</div>"
    rows = f"<body><h1>Head</h1>{''.join(f'<p>{t}' for t in long)}<p>{short}</p>Contact<hr>Up</body>"
    want = ["\n".join([*long[:2], "Share", "Print", *long[2:]]), f"Head\n{short}\n{long[0] * 9}", "\n".join(["Head", *long, short])]
    assert [html_text.article(p) for p in (loose, marked, rows)] == want
    monkeypatch.setattr(html_text, "between_surges", lambda weight, threshold: weight >= 0)
    assert all(html_text.article(p) != w for p, w in zip((loose, marked, rows), want))


def test_no_text_is_lost_to_letters_gaps_links_or_comments():
    rng = random.Random(26)
    paragraphs = [prose(rng, n) for n in (200, 3, 60, 4)]
    turkish = f"<p>{'İ' * 30}</p><script>x</script><p>{paragraphs[0]}</p><p>{paragraphs[1]}</p>"
    assert html_text.article(turkish) == "\n".join(["İ" * 30, *paragraphs[:2]])
    gap = "<div class=ad><p>Buy</p></div>" * 5
    for tag in ("article", "div", "body"):
        assert html_text.article(f"<{tag}>" + gap.join(f"<p>{p}</p>" for p in paragraphs) + f"</{tag}>") == "\n".join(paragraphs)
    nested = "<p>" + paragraphs[0] + " <a href=x><i><b><u><s>link</s></u></b></i></a></p><ul>" + "<li><a href=x><i><b><u><s>All of it</s></u></b></i></a>" * 9 + "</ul>"
    assert html_text.article(nested) == paragraphs[0] + " link"
    assert html_text.article(f"<a name=top><p>{paragraphs[0]}<p>{paragraphs[3]}") == f"{paragraphs[0]}\n{paragraphs[3]}"
    assert html_text.article(f"<article><p>{paragraphs[0]}</article><article class='comment odd'><p>{paragraphs[2]}</article>") == paragraphs[0]
    assert html_text.article("<p>a</p><SCRIPT>x</scripty></Script ><p>b</p>") == "a\nb"


def test_extract_repeated_clashing_and_empty(spark):
    rows = [(1, "u", PAGE, "x")] * 3 + [(2, "v", "<p>y", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").selectExpr("*", "7 AS n_chars")
    got = html_text.extract(df).collect()
    assert sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got) == [(1, "u", html_text.article(PAGE), len(html_text.article(PAGE)))] * 3 + [(2, "v", "y", 1)]
    assert html_text.extract(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"] and html_text.extract(df.limit(0)).count() == 0


def test_extract_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>" * 20_000 + "x"), (3, "u", "<p>y"), (None, "u", "<" * 50_000)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)


tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

PIECES = ["'s", "'", "'ll", "'re", " ", "  ", "\n", "\t", "a", "b", "the", "é", "日本", "12", "9", "!", "?!", "<|endoftext|>", "<|startoftext|>", "<|endof", "\u3000", "\u200b", "x'd", "ſ", "İ", "٣", "½", "́", "🙂", "\r\n", "S", "'S", "''s", " 's", "\x85", "\x1c", "ing", "tion"]


def mixed(rng, n):
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_transducer_equals_the_library_and_round_trips():
    model, library = bpe.transducer(public.path("byte_bpe_50k.json")), tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rng = random.Random(9)
    texts = mixed(rng, 4000) + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(2500)) for k in (1, 2, 3, 5, 26)] + ["the" * 900, "é" * 1500, "!" * 3000, " " * 3000, "ation" * 700, ""]
    ids = model.encode(texts)
    for t, mine, theirs in zip(texts, ids, library.encode_batch(texts, add_special_tokens=False)):
        assert mine.tolist() == theirs.ids, t[:80]
        assert model.decode(mine) == library.decode(theirs.ids, skip_special_tokens=False) == t
    assert model.decode(ids[5], step=1) == texts[5]


def test_stream_needs_only_its_window():
    model = bpe.transducer(public.path("byte_bpe_50k.json"))
    rng = random.Random(10)
    for letters in ("ab", "thein", "abcdefghijklmnopqrstuvwxyz"):
        raw = "".join(rng.choice(letters) for _ in range(5000)).encode()
        for step in (1, 7, 100, 5000):
            assert list(model.stream(raw[i : i + step] for i in range(0, len(raw), step))) == model.merge_window(raw)


def test_pieces_cut_where_nothing_changes(monkeypatch):
    model = bpe.transducer(public.path("byte_bpe_50k.json"))
    text = prose(random.Random(11), 3000)
    whole = model.encode([text])[0].tolist()
    monkeypatch.setattr(bpe, "STREAM_CHARS", 100)
    assert model.encode([text])[0].tolist() == whole


def thue_morse():
    """Two words of 1,024 letters that polynomial hashes modulo 2^64 cannot tell apart."""
    x = "a"
    for _ in range(10):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_words_of_one_weak_hash_stay_apart(spark, monkeypatch):
    x, y = thue_morse()
    data = np.frombuffer(f"{x} {y} {x}".encode(), np.uint8)
    starts = np.array([0, 1025, 2050])
    hashes = textvec.spans_hash(data, starts, starts + 1024)
    assert hashes[0] == hashes[2] != hashes[1]
    monkeypatch.setattr(textvec, "spans_hash", lambda data, starts, ends, lower=False: np.zeros(len(starts), np.uint64))
    words = mixed(random.Random(18), 300) + [x, y, "a", "b", "", x]
    ends = np.cumsum([len(w.encode()) for w in words])
    first, back = textvec.distinct(np.frombuffer("".join(words).encode(), np.uint8), ends - [len(w.encode()) for w in words], ends)
    assert [words[first[k]] for k in back] == words and len(first) == len(set(words))
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    model = bpe.Transducer(public.path("byte_bpe_50k.json"))
    assert [i.tolist() for i in model.encode(words)] == [library.encode(w, add_special_tokens=False).ids for w in words]
    lengths, library = token_counts.Lengths(public.path("word_bpe_49k.json")), tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    assert lengths.of(*textvec.utf8(pa.array(words))).tolist() == [len(library.encode(w, add_special_tokens=False)) for w in words]


def test_every_token_leaves_a_window():
    model, rng = bpe.Transducer(public.path("byte_bpe_50k.json")), random.Random(19)
    words = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in range(1, 900, 7)]
    assert len(set(words)) == len(words)
    ids = model.encode(words)
    assert model.emitted == sum(map(len, ids)) > 2000
    # Windows let tokens go before the stream has ended: a round never sees more than its window.
    seen, merged = [], model.merged
    model.merged = lambda data, starts, ends: seen.append(int((ends - starts).max())) or merged(data, starts, ends)
    model.known = textvec.Remembered(bpe.KNOWN)
    assert [x.tolist() for x in model.encode(words)] == [x.tolist() for x in ids] and max(seen) == model.window and len(seen) >= 2


@pytest.mark.parametrize("chars", [40, 300, 5000])
def test_long_texts_flow_as_the_library_has_them(monkeypatch, chars):
    model, library = bpe.transducer(public.path("byte_bpe_50k.json")), tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    monkeypatch.setattr(bpe, "STREAM_CHARS", chars)
    rng = random.Random(20)
    scripts = ["日本語漢字仮名", "ПРИВЕТмир", "abcdefgh", "ABCDE", " ", "!?.", "0123", " \n\t", "a'sre ll"]
    texts = ["".join(rng.choice(s) for _ in range(9000)) for s in scripts] + ["".join(mixed(rng, 600)) for _ in range(6)] + ["<|endoftext|>".join("日" * n for n in (1, 3000, 0, 700))]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert model.encode([text])[0].tolist() == want
        n, of_ids, of_text = model.digests(text)
        assert (n, of_ids, of_text) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_a_long_text_of_one_script_needs_bounded_memory():
    code = """
import resource, public_tokenizers
from webloom.llm import bpe
model, text = bpe.transducer(public_tokenizers.path("byte_bpe_50k.json")), "漢字" * 8_500_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
print(model.digests(text)[0] > 0, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done, grown = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert done == "True" and int(grown) < 300


def test_a_piece_without_white_space_is_counted_whole():
    lengths, library = token_counts.Lengths(public.path("word_bpe_49k.json")), tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    for text in ("漢字" * 300_000, "x1" * 300_000, "q" * 500_000):
        assert lengths.of(*textvec.utf8(pa.array([text]))).tolist() == [len(library.encode(text, add_special_tokens=False))]


def test_encode_and_count_odd_rows(spark, odd, empty):
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for r in bpe.encode_decode(odd, public.path("byte_bpe_50k.json"), outputs=True).collect():
        assert r["n_tokens"] == len(r["ids"]) and library.decode(r["ids"], skip_special_tokens=False) == r["decoded"]
    assert bpe.encode_decode(empty, public.path("byte_bpe_50k.json")).count() == 0
    assert token_counts.count_tokens(odd, public.path("word_bpe_49k.json")).count() == 10
    assert token_counts.count_tokens(empty, public.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, name):
    texts = mixed(random.Random(12), 600) + ["", None, "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, public.path(name)).collect()}
    if name.endswith(".model"):
        sentencepiece = pytest.importorskip("sentencepiece")
        model = sentencepiece.SentencePieceProcessor(model_file=public.path(name))
        want = [len(model.encode(t or "")) for t in texts]
    else:
        library = tokenizers.Tokenizer.from_file(public.path(name))
        want = [len(library.encode(t or "", add_special_tokens=False)) for t in texts]
    assert [got[i] for i in range(len(texts))] == want


def test_known_pieces_stay_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN", 50)
    lengths = token_counts.Lengths(public.path("word_bpe_49k.json"))
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rng = random.Random(13)
    for _ in range(20):
        texts = mixed(rng, 30)
        assert lengths.of(*utf8(pa.array(texts))).tolist() == [len(library.encode(t, add_special_tokens=False)) for t in texts]
        assert len(lengths.known) <= 50


def edit_distance_to_any_stretch(item, words):
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        before, row = row, [i]
        for j, x in enumerate(words, 1):
            row.append(min(before[j - 1] + (w != x), before[j] + 1, row[j - 1] + 1))
    return min(row)


def test_leaks_against_brute_force(spark):
    rng = random.Random(14)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 7))) for _ in range(800)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randrange(6, 50)))) for k in range(25)] + [(k, " ".join(rng.choices(vocab, k=1 + k % 6))) for k in range(25, 45)] + [(98, " ?! "), (99, None)]
    docs = []
    for d in range(120):
        words = rng.choices(vocab, k=rng.randrange(5, 150))
        if d % 2:
            leak = items[rng.randrange(45)][1].split()
            for _ in range(rng.randrange(0, len(leak) // 4 + 1)):
                p = rng.randrange(len(leak))
                leak[p : p + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(2)
            at = rng.randrange(len(words))
            words[at:at] = leak
        docs.append((d, (" ".join(words)).upper() if d % 3 else ", ".join(words)))
    docs += [(200, None), (201, "")]
    got = {}
    for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect():
        words, item = re.findall(r"[a-z0-9]+", docs[r["doc_id"]][1].lower()), items[r["item_id"]][1].split()
        # The reported stretch has the reported distance.
        assert plain_distance(item, words[r["start_word"] : r["end_word"]]) == r["distance"]
        key = r["doc_id"], r["item_id"]
        got[key] = min(r["distance"], got.get(key, 99))
    want = {}
    for d, t in docs:
        words = re.findall(r"[a-z0-9]+", (t or "").lower())
        for k, i in items[:45]:
            item = i.split()
            best = edit_distance_to_any_stretch(item, words)
            if best <= decontaminate.most_edits(len(item)):
                want[d, k] = best
    assert set(got) <= set(want) and all(got[x] == want[x] for x in got)
    assert len(got) >= decontaminate.RECALL * len(want) and len(want) > 60
    assert {x for x in want if want[x] == 0} <= set(got)  # exact occurrences are never missed


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[j - 1] + 1))
    return row[-1]


def test_least_distance_takes_the_earliest_end_and_the_latest_start():
    rng = random.Random(28)
    for _ in range(300):
        item, region = ([rng.randrange(3) for _ in range(rng.randrange(1, n))] for n in (7, 14))
        every = [(plain_distance(item, region[a:b]), b, -a) for a in range(len(region) + 1) for b in range(a, len(region) + 1)]
        d, b, a = min(every)
        got = decontaminate.least_distance(np.array(item, np.uint64), np.array(region, np.uint64))
        assert got == (d, -a, b)


def test_items_without_spaces_and_of_one_word(spark):
    docs = spark.createDataFrame([(1, "前文。機械学習の基礎を学ぶための問題集です。後文"), (2, "the Zyzzyva sits"), (3, "none of it")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "機械学習の基礎を学ぶ為の問題集です"), (2, "zyzzyva"), (3, "zyzzyva sits"), (4, "sits the")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 1): 2, (2, 2): 0, (2, 3): 0}


def test_one_long_item_among_many_needs_bounded_memory():
    code = """
import random, resource, numpy as np, pyarrow as pa
from webloom.llm import decontaminate as d
from webloom.llm.textvec import utf8
rng = random.Random(1)
texts = [" ".join(str(rng.randrange(10**6)) for _ in range(n)) for n in [20] * 3000 + [20_000]]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
items = d.Items(list(range(len(texts))), texts)
words = texts[-1].split()
words[5:6], words[900:902] = [], ["x"]
found = items.matches(d.words_in(*utf8(pa.array(["a b " + " ".join(words) + " c", texts[7]]))))
print(sorted((r, items.ids[k][0], e) for r, k, e, _, _ in found), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, sep="|")
"""
    found, grown = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split("|")
    assert found == "[(0, 3000, 3), (1, 7, 0)]" and int(grown) < 500


def test_very_common_pieces_are_taken_in_parts(monkeypatch):
    """Many items share all their words but one, and the text is full of these."""
    texts = [f"what is the of what is the {k} of what is the" for k in range(3000)]
    items = decontaminate.Items(list(range(3000)), texts)
    data = utf8(pa.array([" ".join(["what is the of"] * 30) + " " + texts[17]]))
    seen, embed = [], decontaminate.embed
    monkeypatch.setattr(decontaminate, "embed", lambda words, starts, sizes, walk: seen.append(len(starts)) or embed(words, starts, sizes, walk))
    found = items.matches(decontaminate.words_in(*data))
    assert (0, 17, 0) in {(r, items.ids[k][0], d) for r, k, d, _, _ in found}
    assert max(seen) * 3 * 13 * 4 <= 2 * decontaminate.PART_BYTES


def test_leaks_odd_rows_and_blocks(spark, odd, empty, monkeypatch):
    bench = spark.createDataFrame([(1, "plain words of one small text"), (2, "plain words of one small text"), (3, None), (4, "")], "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1)
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, bench).collect())
    assert got == [(5, 1), (5, 1), (5, 2), (5, 2), (6, 1), (6, 2)]
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(odd, bench.limit(0)).count() == 0
