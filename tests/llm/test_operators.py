"""Operators against brute force, exact round trips and held-out rows."""

import base64
import hashlib
import json
import random
import re

import numpy as np
import pytest
from docloom.llm import chat, components, decontaminate, html_text, jaccard_join, line_dedup, packing, pii, quality, rolling, secrets, substring_dedup
from oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    rows = duck(SF).execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    rng = random.Random(5)
    some = [t for _, t in rows if 300 < len(t or "") < 3000][:25]
    more = []
    for t in some:  # near copies, each edited in other places
        words = t.split(" ")
        for _ in range(4):
            own = list(words)
            for _ in range(max(1, len(own) // 60)):
                own[rng.randrange(len(own))] = "edited"
            more.append(" ".join(own))
    return [*rows, *((10_000 + i, t) for i, t in enumerate(more))]


def frame(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("module", [decontaminate, chat, line_dedup])
def test_equals_sql(spark, module):
    con = duck(SF)
    for name, sql in module.ORACLE.items():
        assert compare(spark, con, module.QUERIES[name], sql, SF) == ""


# --- secrets ----------------------------------------------------------------------------------------------------


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


RSA = der(0x30, der(2, b"\0"), *(der(2, bytes([7 + i] * 20)) for i in range(8)))
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, RSA))
SEC1 = der(0x30, der(2, b"\1"), der(4, b"k" * 32), der(0xA0, der(6, b"\x2a\x03")))
SSH = secrets.MAGIC + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"".join(len(x).to_bytes(4, "big") + x for x in (b"pub", b"private" * 9))


def b64u(x):
    return base64.urlsafe_b64encode(x).rstrip(b"=").decode()


def test_structures():
    assert all(map(secrets.is_der_key, (RSA, PKCS8, SEC1))) and secrets.is_openssh_key(SSH)
    for good in (RSA, PKCS8, SEC1):
        for bad in (good[:-1], good + b"\0", b"\x31" + good[1:], good[:1] + bytes([good[1] ^ 1]) + good[2:], b""):
            assert not secrets.is_der_key(bad)
    assert not any(secrets.is_openssh_key(x) for x in (SSH[:-1], SSH + b"x", SSH[1:], secrets.MAGIC))


def test_confirmed_spans():
    token = f"{b64u(json.dumps({'alg': 'HS256'}).encode())}.{b64u(b'{}')}.sig"
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{base64.encodebytes(RSA).decode()}-----END RSA PRIVATE KEY-----"
    text = f"é {token} {pem} {base64.b64encode(PKCS8).decode()} {SEC1.hex()} {base64.b64encode(SSH).decode()} {b64u(b'x' * 60)} {'ab' * 40} aaa.bbbbbbbb.ccc"
    got = {(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.confirmed_spans(text)}
    assert got == {("token", token), ("pem", pem), ("der", base64.b64encode(PKCS8).decode()), ("der", SEC1.hex()), ("openssh", base64.b64encode(SSH).decode())}
    none = [f"{b64u(b'[1]')}.{b64u(b'{}')}.x", f"{b64u(b'{}')}.{b64u(b'{}')}.x", pem.replace(base64.encodebytes(RSA).decode(), base64.encodebytes(RSA[:-3]).decode()), "-----BEGIN PRIVATE KEY-----\n\n-----END PRIVATE KEY-----"]
    assert all(secrets.confirmed_spans(x) == [] for x in none)


def wrapped(text, size, end):
    return end.join(text[k : k + size] for k in range(0, len(text), size))


def test_keys_in_source_text_and_over_lines():
    body, ssh = base64.b64encode(PKCS8).decode(), base64.b64encode(SSH).decode()
    pems = [f"-----BEGIN PRIVATE KEY-----{end}{wrapped(body, 64, end)}{end}-----END PRIVATE KEY-----{end}" for end in (r"\n", r"\r\n", r"\\n", '\\n" +\n  "')]
    for pem in pems:
        text = f'{{"type": "service_account", "private_key": "{pem}"}}'
        at = text.index("-----BEGIN")
        assert secrets.confirmed_spans(text) == [(at, 4, text.index("KEY-----", text.index("-----END")) + 8)]
    for kind, plain in ((5, body), (6, ssh), (5, SEC1.hex()), (5, PKCS8.hex().upper()), (6, SSH.hex())):
        for size, end in ((64, "\n"), (76, "\r\n    "), (32, "\\n"), (1000, "")):
            for before, after in (("a key: ", " and"), ("path/", "\n"), ("-", " "), ("x_", "\nThe end"), ("\\n", "\\n"), ("0x", ",")):
                key = wrapped(plain, size, end)
                text = f"é {before}{key}{after} more"
                at = text.index(key)
                assert secrets.confirmed_spans(text) == [(at, kind, at + len(key))], (text, size)
    lines = "0x" + wrapped(PKCS8.hex(), 64, "\n0x")
    assert secrets.confirmed_spans(lines) == [(2, 5, len(lines))]
    cut = base64.b64encode(PKCS8[:-3]).decode()
    assert all(secrets.confirmed_spans(wrapped(x, 64, "\n")) == [] for x in (base64.b64encode(b"x" * 300).decode(), "30" * 200, "MIIC" * 200)) and not any(a == 0 for a, _, _ in secrets.confirmed_spans(cut))


def test_base_spans():
    text = 'Token = "abc123" PASSWORD:"longenough" api-key=nope1234 api_key=\'12345678\' ſecret=12345678 AKIAABCDEFGHIJKL AKIAAKIA deadbeef ' + "0f" * 16 + "Z" + "a" * 31
    want = []
    for kind, pattern, flags, ok in (
        (0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 8),
        (1, r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16), (2, r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
    ):
        want += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if ok(m)]
    assert sorted(secrets.base_spans(text)) == sorted(want) and [k for _, k, _ in sorted(want)] == [0, 0, 1, 2]


# --- html -------------------------------------------------------------------------------------------------------


def test_html():
    page = """<html><head><title>T</title></head><body class="with-sidebar"><header><h1>Site</h1></header><div id="main-menu"><a href=/>Home</a></div>
    <div class=cookie-notice>We use cookies</div><div class="content"><h1>Title &amp; more</h1><p>First  <b>bold</b> para<br>goes on &lt;here&gt;.<p>Second para is long enough to count, as it has many words in it.
    <script>var a = "<p>no</p>"</script><ul><li>one<li>two</ul><div class="advert">buy</div><form><p>mail</p></form><pre>a
    b</pre></div><aside>side</aside><section class="comments"><p>reader says something rather long here, so long that it might count</p></section><footer>foot</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more\nFirst bold para goes on <here>.\nSecond para is long enough to count, as it has many words in it.\none\ntwo\na b"
    assert html_text.main_text("<p>&am &amp &#233; &copy;x &nosuch;</p>") == "&am & é ©x &nosuch;"
    assert html_text.main_text("<article><p>short</p></article><div class=ad>" + "very long advert " * 50 + "</div>") == "short"
    assert html_text.main_text("<div><p>a <!-- x > --> b<p>c</div><p>d") == "a b\nc\nd"
    assert html_text.main_text("<table><tr><td>x<td>y<tr><td>z</table>") == "x\ny\nz"


def test_forms_and_names_of_article_parts():
    para = "A sentence of the article that is long enough to be real text. " * 3
    one = para.strip()
    assert html_text.main_text(f"<body><form id=form1><input type=hidden name=v><h1>Title</h1><p>{para}<p>{para}<input type=submit></form></body>") == f"Title\n{one}\n{one}"
    assert html_text.main_text(f"<body><div><p>{para}<p>{para}<form><p>{para}<p>{para}<input></form><form>Your mail <input><input><button>Go</button></form></div></body>") == "\n".join([one] * 4)
    parts = "<h2 id=related-work>Related</h2>", f"<section id=discussion><p>{para}</p></section>", "<h2 id=privacy>Privacy</h2>", f"<div class=notice>{para}</div>", f"<p class=search>{para}</p>", "<h2 class=header id=comments>Comments</h2>"
    want = "\n".join(re.sub(r"<[^>]*>", "", x).strip() for x in parts)
    for name in ("article", "main"):
        assert html_text.main_text(f"<body><{name}>{''.join(parts)}</{name}><div class=comments>{para}</div></body>") == want
        cut = "<div class=ad>Buy</div><div class='related'><a href=x>Other page</a> <a href=y>Third page</a></div><p hidden>no</p><div id=comments><p>reader</p></div><form>mail <input><button>ok</button></form><div class=share-buttons>Share</div>"
        assert html_text.main_text(f"<body><{name}><p>{para}</p>{cut}</{name}></body>") == one
    assert html_text.main_text(f"<main><article><p>{para}</article><section class=discussion><p>{para * 5}</section></main>") == one


def test_html_of_pages():
    for (page,) in duck(SF).execute("SELECT html FROM pages").fetchall():
        article = re.search(r"(?s)<article>(.*)</article>", page)[1]
        parts = [re.sub(r"\s+", " ", html_text.html.unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        assert html_text.main_text(page) == "\n".join(p for p in parts if p)


def test_density_sums():
    root = html_text.parse("<body><div><p>" + "text " * 30 + "</p><p>" + "more " * 20 + "</p></div><div><a>link one</a><a>link two</a></div></body>")
    nodes = html_text.measure(root)
    body = next(n for n in nodes if n.name == "body")
    first, second = (c for c in body.children if isinstance(c, html_text.Node))
    assert first.sum > second.sum and first.density > second.density and first.tags == 2 and second.links == 2 and second.linked == second.chars


# --- substrings -------------------------------------------------------------------------------------------------


def brute_substrings(rows, size=50):
    seen, out = {}, {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - size + 1):
            if seen.setdefault(raw[j : j + size], i) < i:
                gone[j : j + size] = b"\1" * size
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), len(raw) - len(kept), sum(g > p for g, p in zip(gone, b"\0" + gone, strict=False)), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings(spark, texts, monkeypatch):
    rng = random.Random(2)
    periodic = [(20_000, "ab" * 200), (20_001, "x" + "ab" * 60 + "y"), (20_002, "abc" * 70), (20_003, "a" * 49), (20_004, "a" * 300), (20_005, "z" + "a" * 51), (20_006, "a" * 50)]
    line = "this very common line is found in a lot of documents, as it happens to be everywhere."
    shared = [(30_000 + i, " ".join(f"{rng.random()}" for _ in range(9)) + line + " ".join(f"{rng.random()}" for _ in range(9))) for i in range(80)]
    rows = [*texts, *periodic, *shared]
    want = brute_substrings(rows)
    for hot in (substring_dedup.HOT, 10):  # with and without dealing windows of crowded anchors
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        assert {r[0]: tuple(r)[1:] for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()} == want


def test_previous_factors():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        docs, lcp = rng.integers(0, 6, n).astype(np.int32), np.r_[0, rng.integers(0, 9, n - 1)].astype(np.int32)
        want = []
        for i in range(n):
            best = 0
            for way in (-1, 1):
                least, at = 10**6, i
                while 0 <= at + way < n:
                    least = min(least, lcp[at] if way < 0 else lcp[at + 1])
                    at += way
                    if docs[at] < docs[i]:
                        best = max(best, least)
                        break
            want.append(best)
        assert substring_dedup.previous_factors(docs, lcp).tolist() == want


def test_suffix_order():
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 2, (200, 50)).astype(np.uint8)
    rows[100:] = rows[:100]
    order, lcp = substring_dedup.suffix_order(rows)
    flat = [bytes(rows[i]) for i in order]
    assert flat == sorted(flat)
    for a, b, n in zip(flat, flat[1:], lcp[1:], strict=False):
        assert n == next((k for k in range(50) if a[k] != b[k]), 50)


# --- quality ----------------------------------------------------------------------------------------------------


def slow_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_statistics(texts):
    odd = ["a b c d e f g h " * 3, "x " * 40, "é ü | <x>\x0bq\r\n\r\nq", "", "a\n\na\n a\na"]
    for t in [*(t for _, t in texts[:60]), *odd]:
        assert quality.statistics((t or "").encode())[:5] == slow_statistics(t or "")


def test_forest_on_held_out_rows():
    con = duck("/root/testdata/sf0.1")
    rows = con.execute("SELECT text, min(quality) FROM documents JOIN labels USING (doc_id) GROUP BY doc_id, text ORDER BY hash(doc_id)").fetchall()
    s, good = np.array([quality.statistics(t.encode()) for t, _ in rows]), np.array([q for _, q in rows]) > 0
    passed = ~quality.base_failed(s)
    s, good = s[passed], good[passed]
    half = len(s) // 2
    f = quality.features(s)
    forest = quality.Forest(f[:half][good[:half]], np.stack([f[:half].min(0), f[:half].max(0)]))
    limit = quality.threshold(forest.score(f[:half]), good[:half])
    score = forest.score(f[half:])
    assert (score[good[half:]] > limit).mean() < 0.01 and (score[~good[half:]] > limit).mean() > 0.6


def test_threshold_balances_both_classes():
    con = duck("/root/testdata/sf0.1")
    rows = con.execute("SELECT text, min(quality) FROM documents JOIN labels USING (doc_id) GROUP BY doc_id, text ORDER BY hash(doc_id)").fetchall()
    s, good = np.array([quality.statistics(t.encode()) for t, _ in rows]), np.array([q for _, q in rows]) > 0
    passed = ~quality.base_failed(s)
    f, good = quality.features(s[passed]), good[passed]
    half = len(f) // 2
    for own, other in ((slice(half), slice(half, None)), (slice(half, None), slice(half))):
        forest = quality.Forest(f[own][good[own]], np.stack([f[own].min(0), f[own].max(0)]))
        score, limit = forest.score(f[other]), quality.threshold(forest.score(f[own]), good[own])
        assert (score[~good[other]] > limit).mean() > 0.97 and (score[good[other]] > limit).mean() < 0.01
    scores, good = np.array([*np.linspace(0, 0.5, 1000), 0.495, 0.51, 0.6]), np.array([True] * 1000 + [False] * 3)
    assert 0.49 < quality.threshold(scores, good) < 0.495  # one good row in a hundred may go for a third of the bad ones
    assert quality.threshold(scores[good], good[good]) > 0.499
    far = np.array([*np.linspace(0, 0.5, 1000), 0.1]), np.array([True] * 1000 + [False])
    assert (far[0][:1000] <= quality.threshold(*far)).mean() >= 0.99  # but no more than that


def test_forest_is_repeatable(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one, two = (quality.assess(d, labels).orderBy("doc_id").collect() for d in (docs, docs.repartition(7)))
    assert one == two and any(not r.kept for r in one) and sum(r.kept for r in one) > len(one) / 2


# --- decontamination --------------------------------------------------------------------------------------------


def brute_hits(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w = split(t)
        hit, ids = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if found := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        out[i] = (len(w), len(hit), sorted(ids))
    return out


ITEMS = [(1, "A b c d e f g h i j k l"), (2, "short ÉTÉ"), (10, "c D e, f-g h i j k l"), (3, "x x x x x x x x x x x"), (4, "short été")]
TAINTED = [(1, "zz a b c d e f g h i j k l m a b c d e f g h i j"), (2, "Short ÉTÉ short"), (3, "x " * 30), (4, "x " * 9), (5, "b c d e f g h i j k"), (6, "...")]


def test_decontamination(spark):
    frames = spark.createDataFrame(TAINTED, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute_hits(TAINTED, ITEMS)
    for limit in (decontaminate.MAX_BROADCAST, 0):  # broadcast and shuffled
        assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.find(*frames, max_broadcast=limit).collect()} == want
    assert sorted(r.doc_id for r in decontaminate.decontaminate(*frames).collect()) == [4, 6]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(*frames, spans=True).collect()}
    assert cut[1] == "zz m" and cut[2] == " short" and cut[3].strip() == "" and cut[4] == "x " * 9 and cut[6] == "..."


# --- near duplicates --------------------------------------------------------------------------------------------


def brute_components(rows):
    sets, out, root = {}, {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, texts, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    family = [(50_000 + k, " ".join(base[:k] + ["new"] * 2 + base[k + 2 :])) for k in range(0, 110, 3)]  # many classes around one text
    chain = [(60_000 + k, " ".join(f"c{i}" for i in range(2 * k, 2 * k + 60))) for k in range(12)]  # only neighbours are similar
    small = [(70_000, "a b c"), (70_001, "A b C"), (70_002, "a b"), (70_003, ""), (70_004, None), (70_005, "a b c d e f"), (70_006, "a b c d e g")]
    edge = [(80_000, " ".join(f"e{i}" for i in range(104))), (80_001, " ".join(f"e{i}" for i in range(79))), (80_002, " ".join(f"e{i}" for i in range(78)))]
    rows = [*texts, *family, *chain, *small, *edge]
    want = brute_components(rows)
    for members in (jaccard_join.BLOCK_MEMBERS, 6):  # in one block and in several
        monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", members)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(frame(spark, rows)).collect()} == want


def test_shingles(texts):
    for _, t in texts[:40]:
        w = (t or "").encode().lower().split()
        assert len(rolling.shingles((t or "").encode().lower(), 5)) == (len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}


# --- pseudonyms -------------------------------------------------------------------------------------------------


def test_permutations():
    for size in (1, 2, 7, 100, 731):
        image = [pii.walk(v, size, b"k", "t") for v in range(size)]
        assert sorted(image) == list(range(size)) and [pii.walk(v, size, b"k", "t", back=True) for v in image] == list(range(size))
    image = [pii.digits(f"{v:03d}", b"k", "t") for v in range(1000)]
    assert len(set(image)) == 1000 and all(len(x) == 3 for x in image) and image != [pii.digits(f"{v:03d}", b"other", "t") for v in range(1000)]


VALUES = ["4417 7442 8035 1541", "4111111111111111", "161.17.88.162", "+1 (243) 555-5526", "(030) 555-1234", "2024-02-29", "3.12.1999", "1/31/2001", "31/01/2001", "a.B7@mail.example.com", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]


@pytest.mark.parametrize("value", VALUES)
def test_pseudonyms(value):
    valid = pii.luhn_ok(re.sub(r"\D", "", value)) if re.fullmatch(r"[\d ]{15,}", value) else True
    text = f"x {value} y, {value}."
    new, spans = pii.replace(text, b"key")
    if not valid:
        assert new == text and not spans
        return
    assert len(spans) == 2 and value not in new and pii.reveal(new, b"key") == text
    again, found = pii.replace(new, b"key")
    assert [k for _, k, _ in found] == [k for _, k, _ in spans]  # a pseudonym has the format of what it stands for
    parts = re.fullmatch(r"x (.*) y, (.*)\.", new)
    assert parts[1] == parts[2]
    assert "@" in value or re.sub(r"\d", "9", re.sub("[A-Z]", "A", parts[1])) == re.sub(r"\d", "9", re.sub("[A-Z]", "A", value)) or spans[0][1] == pii.KINDS.index("ip")


def test_pseudonyms_link_and_leave():
    one, two = (pii.replace(x, b"k")[0] for x in ("4111 1111 1111 1111", "4111-1111-1111-1111"))
    assert one.replace(" ", "-") == two and pii.luhn_ok(one.replace(" ", ""))
    for other in ("4111111111111112", "1.2.3", "999.1.1.1", "2023-02-30", "version 2.0.1", "a@b", "12345", "DE00 3704 0044 0532 0130 00", "no digits"):
        assert pii.replace(other, b"k") == (other, [])


NEIGHBOURS = ["4111 1111 1111 1111 12/27", "1 4111 1111 1111 1111", "7536784127813050 4111111111111111", "4111 1111 1111 1111 5500 0000 0000 0004", "4111 1111 1111 1111 2024-02-29", "161.17.88.162 4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89370400440532013000 EUR 50", "IBAN DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 X", "AB12 DE89 3704 0044 0532 0130 00", "DE89370400440532013000 Euro"]


@pytest.mark.parametrize("text", NEIGHBOURS)
def test_pseudonyms_beside_other_groups(text):
    new, spans = pii.replace(f"x {text} y", b"key")
    values = [v for v in ("4111 1111 1111 1111", "4111111111111111", "7536784127813050", "5500 0000 0000 0004", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82WEST12345698765432", "161.17.88.162", "2024-02-29") if v in text]
    assert {f"x {text} y"[a:b] for a, _, b in spans} == set(values) and not any(v in new for v in values)
    assert pii.reveal(new, b"key") == f"x {text} y"


def test_neighbours_do_not_hide_values():
    rng = random.Random(6)
    for k in range(300):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        plain = body + pii.luhn_digit(body)
        value = plain if k % 2 else " ".join(plain[i : i + 4] for i in range(0, 16, 4))
        text = f"{rng.randrange(10 ** rng.randint(1, 5))} {value} {rng.randrange(10 ** rng.randint(1, 5))}"
        new, spans = pii.replace(text, b"key")
        assert spans and value not in new and pii.reveal(new, b"key") == text


def test_date_permutation():
    days = [f"{pii.datetime.date.fromordinal(pii.FIRST + d)}" for d in range(0, pii.DAYS, 97)]
    new = [pii.replace(d, b"k")[0] for d in days]
    assert len(set(new)) == len(days) and all(pii.datetime.date.fromisoformat(x) for x in new)


# --- chat -------------------------------------------------------------------------------------------------------


def test_template(spark):
    odd = ["</s>[INST] ok [/INST]", "a \\ b \\l \\k \\b \\n", "<|im_start|>user\nhi<|im_end|>\n", "< s > [x]", "<<SYS>><</SYS>>", "\n", "", "<<s>"]
    rows = [(c, i, ("user", "assistant")[i % 2] if c else "ro\nle\\", t) for c in (0, 1) for i, t in enumerate(odd)]
    examples = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    full = examples.filter("example = n_examples - 1")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in full.select("conv_id", chat.read_turns(full["formatted"]).alias("turns")).collect()}
    assert got == {c: [(r, t) for c2, _, r, t in rows if c2 == c] for c in (0, 1)}
    own = examples.filter("conv_id = 1 and loss_end > loss_start or conv_id = 1 and example < 4").orderBy("example")
    loss = [r[0] for r in own.select(chat.read_loss(own["formatted"], own["loss_start"], own["loss_end"])).collect()]
    assert loss == odd[1::2]
    for r in examples.collect():
        inside = r.formatted[len(chat.START) : -len(chat.END)].replace(chat.END + chat.START, "")
        assert not any(c in inside for c in chat.CONTROL)


# --- lines ------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    first, gone = {}, {i: set() for i, _ in rows}
    for i, t in sorted(rows):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not any(x.strip(" ") for x in w):
                continue
            d, q = first.setdefault(w, (i, p))
            if (d, q) != (i, p):
                gone[i] |= set(range(max(p, q + 3) if d == i else p, p + 3))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_lines(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice("abcd ") for _ in range(rng.randint(1, 30)))) for i in range(80)]
    rows += [(100, "a\n" * 20), (101, "p\nq\nr\ns"), (102, "x\np\nq\nr\ny"), (103, "q\nr\ns")]
    assert {r.doc_id: r.text for r in line_dedup.marked(frame(spark, rows)).collect()} == brute_lines(rows)


# --- packing ----------------------------------------------------------------------------------------------------


def brute_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def test_plan():
    rng = random.Random(9)
    for _ in range(200):
        capacity = rng.choice([10, 37, 100])
        sizes = [rng.randint(1, capacity) if rng.random() < 0.7 else rng.randint(1, 3) for _ in range(rng.randint(0, 150))]
        counts = {s: sizes.count(s) for s in set(sizes)}
        taken, ranks = {}, {}
        for size, rank, n, first, offset in packing.plan(counts, capacity):
            for k in range(n):
                ranks.setdefault(size, []).append(rank + k)
                taken.setdefault(first + k, []).append((offset, size))
        assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}
        for places in taken.values():
            places.sort()
            assert places[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(places, places[1:], strict=False)) and sum(places[-1]) <= capacity
        assert sorted(capacity - sum(max(p)) for p in taken.values()) == brute_best_fit(sizes, capacity)


TRICKY = ["İstanbul it's <|endoftext|> a<|startoftext|>b x́  y…!! été́, 12,34 'SAY'll don't\x1c\x85ß ǅ ﬁne", "", "Σας ΣΑΣ, 中文字。 日本 é ́ a​b", "a'b 'S !'s '.s it's. we'll x's's (it's)! ''s", "Åå Å ſ's x<y a<|b|>c", "x1y2 ½ ² Ⅷ 　x\xa0y école ÉCOLE", "w" * 3000]


def test_tokens(texts, monkeypatch):
    own = [t or "" for _, t in texts] + TRICKY
    coder = packing.Encoder(packing.default_tokenizer())
    want = [e.ids for e in coder.tokenizer.encode_batch(own, add_special_tokens=False)]
    raws = [t.encode() for t in own]
    for part, kept in ((1 << 20, 2_000_000), (1 << 20, 2_000_000), (300, 0), (40, 5)):
        monkeypatch.setattr(packing, "PART", part)
        monkeypatch.setattr(packing, "CACHE", kept)
        coder = coder if kept > 5 else packing.Encoder(packing.default_tokenizer())
        assert [x.tolist() for x in coder.ids(raws)] == want


def test_packing(spark, texts):
    import zlib

    rows = [*texts[:60], (9_999_999, " ".join(f"tok{i}" for i in range(4000)))]
    got = packing.pack(frame(spark, rows), packing.default_tokenizer(), length=256, keep_ids=True).collect()
    tokenizer = packing.Encoder(packing.default_tokenizer()).tokenizer
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == ids and all(r.length == 256 for r in own[:-1]) and [r.start for r in own] == [256 * k for k in range(len(own))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert places[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(places, places[1:], strict=False)) and sum(places[-1]) <= 256
    assert len(by) == len(brute_best_fit([r.length for r in got], 256))
