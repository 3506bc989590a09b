"""Secret, personal-data, URL, HTML, license, leak and language operators against plain versions."""

import base64
import hashlib
import json
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contentloom.llm import decontam, htmltext, langid, licenses, pii, secrets, urlfilter
from contentloom.llm.textkernel import ALNUM, pieces, shingle_sets, word_hashes, words


def digest(spans, kinds):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))).encode()).hexdigest()


# --- words and shingles


@pytest.mark.parametrize("seed", range(5))
def test_kernel_equals_plain_sets(seed, monkeypatch):
    r = random.Random(seed)
    texts = ["".join(r.choice("abAB \t\n\x0b\x0c\r\xa0é ") for _ in range(r.choice([0, 1, 5, 40, 400]))) if r.random() < 0.9 else None for _ in range(60)]
    monkeypatch.setattr("contentloom.llm.textkernel.PIECE", r.choice([1, 50, 10_000]))
    seen = {}
    for k, found in shingle_sets(pa.array(texts)):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[k] or ""))
        plain = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert len(found) == len(plain)
        for key, value in zip([tuple(sorted(plain))], [tuple(found.tolist())], strict=True):
            assert seen.setdefault(key, value) == value
    assert len({v for v in seen.values()}) == len(seen)


# --- secrets


def tlv(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 | len(b := size.to_bytes((size.bit_length() + 7) // 8, "big"))]) + b
    return bytes([tag]) + head + body


def number(n):
    b = n.to_bytes(n.bit_length() // 8 + 1, "big")
    return tlv(2, b)


def rsa_key(seed):
    r = random.Random(seed)
    return tlv(0x30, number(0) + b"".join(number(r.getrandbits(n) | 1) for n in (512, 17, 510, 256, 256, 250, 250, 250)))


def test_secrets_spans():
    key = rsa_key(1)
    body = base64.encodebytes(key).decode()
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{body}-----END RSA PRIVATE KEY-----"
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()).decode().rstrip("=")
    token = f"{head}.{base64.urlsafe_b64encode(b'{}x').decode().rstrip('=')}.sig_-"
    ssh = struct.pack(">I", 11) + b"ssh-ed25519" + struct.pack(">I", 32) + bytes(range(32))
    ssh = base64.b64encode(ssh).decode()
    eight = tlv(0x30, number(0) + tlv(0x30, tlv(6, bytes.fromhex("2b6570"))) + tlv(4, tlv(4, bytes(32))))
    text = f"é {pem}\n{token} and ssh-ed25519 {ssh} hex {eight.hex()} prose they.are.fine {'A' * 64}"
    base, more = secrets.find_secrets(text)
    kinds = {k: text[a:b] for k, a, b in more}
    assert kinds["token"] == token and kinds["public_key"] == ssh
    assert sorted(text[a:b].replace("\n", "") for k, a, b in more if k == "private_key") == sorted([body.replace("\n", ""), eight.hex()])
    assert [k for k, _, _ in base] == ["hex"]
    assert secrets.redact(text).count("[SECRET]") == 4 and "é -----BEGIN" in secrets.redact(text)
    for bad in (key[:-1], key + b"\0", tlv(0x30, number(3) + number(5)), b"\x30\x80", b"", b"0"):
        assert secrets.key_kind(bad) is None
    assert secrets.redact("nothing here") == "nothing here"


def test_keys_in_other_wrappings():
    short = tlv(0x30, number(0) + tlv(0x30, tlv(6, bytes.fromhex("2b6570"))) + tlv(4, tlv(4, bytes(range(32)))))
    ssh = b"openssh-key-v1\0" + b"".join(struct.pack(">I", len(x)) + x for x in (b"none", b"none", b"")) + struct.pack(">I", 1) + struct.pack(">I", 51) + bytes(51) + struct.pack(">I", 136) + bytes(136)
    public = b"".join(struct.pack(">I", len(x)) + x for x in (b"ssh-rsa", b"\1\0\1", bytes(range(1, 256))))
    for key, kind in ((rsa_key(3), "private_key"), (short, "private_key"), (ssh, "private_key"), (public, "public_key")):
        whole = base64.b64encode(key).decode()
        lines = [whole[k : k + 64] for k in range(0, len(whole), 64)]
        bare = "\n".join(lines).rstrip("=")
        pem = lambda sep, lines=lines: f"-----BEGIN PRIVATE KEY-----{sep}{sep.join(lines)}{sep}-----END PRIVATE KEY-----"
        cases = {f'{{"key": "{pem(sep)}"}}': sep.join(lines) for sep in (r"\n", r"\r\n", r"\\n", "", " ", "\r\n", "\n    ", "\n\t")}
        cases |= {f"{bare}\none\ntwo\nthree\nfour": bare, f"x: {whole} and more": whole, f"{bare}\n{bare}\nend": None}
        for text, want in cases.items():
            found = [(k, text[a:b]) for k, a, b in secrets.confirmed_spans(text)]
            assert found == ([(kind, want)] if want else [(kind, bare)] * 2), text
            assert lines[0] not in secrets.redact(text) and lines[-1] not in secrets.redact(text)
        for bad in (whole[:-8], f"x{whole}", whole[4:], f"{lines[0]}\n\n{whole[64:]}" if len(lines) > 1 else ""):
            assert secrets.confirmed_spans(bad) == []


def test_secrets_base_equals_plain_patterns(spark):
    r = random.Random(2)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "=", ":", "AKIA", "ABCD1234EFGH5678", "abcdef0123456789", "a1b2", "\n", "é", "ſecret", "xyz_.-/+=", "words "]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randint(0, 60)))) for k in range(300)] + [(900, None), (901, ""), (902, "a" * 200_000), (902, "a" * 200_000), (None, "token = abcdefghijkl")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    found = secrets.scan_secrets(docs).collect()
    assert len(found) == len(rows)
    want = {}
    for k, text in rows:
        text = text or ""
        spans = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
        spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        want[k] = (*(sum(s[0] == kind for s in spans) for kind in secrets.KINDS[:3]), digest(spans, secrets.KINDS))
    assert {x.doc_id: (x.n_assign, x.n_access, x.n_hex, x.base_sha256) for x in found} == want
    assert sum(sum(w[:3]) for w in want.values()) > 100
    assert secrets.scan_secrets(docs.limit(0)).collect() == []


# --- personal data


def plain_personal(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_personal_base_equals_plain_patterns(spark):
    r = random.Random(3)
    parts = ["@", ".", "a.b", "x_y", "%+", "-", "com", "10", "255", "256", "007", " ", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "+", "\n", "é", "word", "1", "٣"]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for k in range(500)] + [(900, None), (901, ""), (902, "9" * 100_000), (903, "a" * 100_000 + "@"), (903, "a" * 100_000 + "@")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1))
    found = pii.scan_personal(docs).collect()
    assert len(found) == len(rows)
    want = {k: plain_personal(t or "") if k != 903 else [] for k, t in rows}
    for x in found:
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(s[0] == kind for s in want[x.doc_id]) for kind in pii.PLAIN), rows[x.doc_id]
        assert x.base_sha256 == digest(want[x.doc_id], pii.KINDS)
    assert pii.scan_personal(docs.limit(0)).collect() == []


@pytest.mark.parametrize(
    "text,kind,hidden",
    [
        ("mail jane.doe [at] mail3 (dot) example [dot] com now", "email", "jane.doe [at] mail3 (dot) example [dot] com"),
        ("mail jane at mail3 dot example dot com now", "email", "jane at mail3 dot example dot com"),
        ("mail john.doe@example dot com now", "email", "john.doe@example dot com"),
        ("mail john@mail dot example dot com now, the dot com boom", "email", "john@mail dot example dot com"),
        ("é jаne@exаmple.com é", "email", "jаne@exаmple.com"),
        ("Write to john.doe at example.com please", "email", "john.doe at example.com"),
        ("juan arroba ejemplo punto es", "email", "juan arroba ejemplo punto es"),
        ("marie arobase exemple point fr", "email", "marie arobase exemple point fr"),
        ("an hans  (at) beispiel (punkt) de!", "email", "hans  (at) beispiel (punkt) de"),
        ("john dot x dot doe at example dot co dot uk", "email", "john dot x dot doe at example dot co dot uk"),
        ("𝐣𝐨𝐡𝐧@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.𝐜𝐨𝐦", "email", "𝐣𝐨𝐡𝐧@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.𝐜𝐨𝐦"),
        ("call +1 five five five one two three four five six seven ok", "phone", "+1 five five five one two three four five six seven"),
        ("card ４１１１ １１１１ １１１１ １１１１.", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("card four one one one one one one one one one one one one one one one!", "card", "four one one one one one one one one one one one one one one one"),
        ("host 10[.]20[.]30[.]40 up", "ip", "10[.]20[.]30[.]40"),
    ],
)
def test_disguised_spans_map_back(text, kind, hidden):
    base, more = pii.find_personal(text)
    assert [(k, text[a:b]) for k, a, b in more] == [(f"disguised_{kind}", hidden)]


def test_clean_text_has_no_disguised_spans():
    for text in ("One two three, meet me at noon. The dot com boom at large.", "Vier Augen sehen mehr als zwei.", "Привет мир 12 34", "tel. one two", "Look at www.python.org now", "He works at google.com daily", "we meet at noon.Then we go", "À ce point de vue, elle arrive at home.Then", "en este punto yo"):
        assert pii.find_personal(text) == ([], [])


def test_spelled_points_of_prose_beside_a_real_at():
    for text in ("Ask @anna dot com or me @ noon dot net.", "Polka dot dresses @ home; 10 dot 20 @ 30", "a@" + "b." * 50_000 + " dot"):
        assert pii.disguised_spans(text, pii.plain_spans(text)) == []
    assert pii.find_personal("jane@example.com has 10 dot 20 dot 30 dot 40 and polka dots")[1] == []


@pytest.mark.parametrize("text", [" " * 1_000_000, "[ " * 300_000, " (at)" * 200_000, "a at " * 200_000, "a dot " * 160_000 + "b@c.de", "@a" * 400_000, "x@a dot b " * 50_000, "+1 " * 300_000, "1." * 400_000, "one " * 200_000])
def test_hostile_texts_take_linear_time(text):
    began = time.perf_counter()
    pii.find_personal(text)
    secrets.find_secrets(text)
    assert time.perf_counter() - began < 10


# --- urls


def test_url_filter(spark):
    urls = ["http://a.example.com/x", "https://EXAMPLE.com/en/1?x#y", "http://www.example.com/en/", "http://x.www.example.com/en/a", "http://notexample.com/en/", "http://b.net/es/1", "http://b.net/es", "http://b.net?/es/", "http://cheap-pills.example.org/fr/1", "http://m.casino-win.example.net/de", "ftp://u@h.net:80/fr/?q", "nothing", "", None, "://", "http:///p", "http://net/es/a", "x://É.Net/es/ü"]
    rows = list(enumerate(urls)) + [(0, urls[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    found = {x.page_id: tuple(x)[1:] for x in urlfilter.filter_urls(pages).collect()}
    assert urlfilter.filter_urls(pages).count() == len(rows)
    for k, url in rows:
        rest = re.split(r"[?#]", url.split("://", 1)[1])[0] if url and "://" in url else ""
        host, slash, path = rest.partition("/")
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path
        fits = [(h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        listed = any(host == b or host.endswith("." + b) for b in urlfilter.BLOCKED_HOSTS)
        assert found[k] == (host, path, rule, verdict or ("block" if listed else "allow")), url


def test_digests_that_collide_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda b: len(b) % 3)
    names = [f"h{'x' * k}.org/" for k in range(30)]
    array = urlfilter.DigestArray(urlfilter.write_array([("block", n) for n in names], str(tmp_path)))
    found = array.probe([*(n.encode() for n in names), b"other", b""])
    assert (found[:30] >= 0).all() and len(set(found[:30])) == 30 and (found[30:] == -1).all()


def test_hosts_from_a_table_and_hostile_urls(spark):
    """A million hosts, and hosts and paths of a million characters."""
    hosts = spark.range(1_000_000).select(F.concat(F.lit("H"), "id", F.lit(".Listed.org")).alias("host")).unionByName(spark.createDataFrame([(None,), ("",)], "host string"))
    rows = [(1, "http://h77.listed.org/x"), (2, "http://a.b.h999999.listed.org"), (3, "http://h1000000.listed.org/"), (4, "http://listed.org/"), (5, "http://" + "a." * 500_000 + "h5.listed.org/" + "p" * 1_000_000), (6, "http://" + "." * 1_000_000), (7, "http://xh77.listed.org/"), (8, "http://n.h3.listed.org.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    began = time.perf_counter()
    found = {x.page_id: x.verdict for x in urlfilter.filter_urls(pages, blocked=hosts).select("page_id", "verdict").collect()}
    assert [k for k in found if found[k] == "block"] == [1, 2, 5] and len(found) == 8 and time.perf_counter() - began < 60
    assert urlfilter.filter_urls(pages.limit(0)).collect() == [] and urlfilter.filter_urls(pages, rules=(), blocked=()).where("verdict <> 'allow'").collect() == []


# --- html


def test_main_text(spark):
    body = "<p>A first paragraph of the article &amp; more.<p>Short.</p><ul><li>One<li>Two</ul><p><b>Bold <i>and</b> long\n text&nbsp;here<br>again</p>"
    shell = f'<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h2>Site</h2></header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies.</div><article><h1>Title</h1>{body}<div class="ad">Buy!</div><aside>See also</aside></article><section id="comments"><article class="comment"><p>I disagree with all of this, at length and for many words.</p></article></section><form>Name<input></form><div id="sidebar">Side</div><footer>&copy; me</footer>'
    want = "Title\nA first paragraph of the article & more.\nShort.\nOne\nTwo\nBold and long text here again"
    assert htmltext.main_text(shell + "</body></html>") == want == htmltext.main_text(shell)
    plain = shell.replace("<article><h1>", '<div class="post"><h1>').replace("</aside></article>", "</aside></div>")
    assert htmltext.main_text(plain) == want
    rows = [(1, "u", shell), (2, None, None), (3, "u", ""), (4, "u", "<p>"), (5, "u", "just text"), (5, "u", "just text"), (6, "u", "<b>" * 3000 + "deep"), (7, "u", "<![x[ odd <p>kept"), (8, "u", "<script>x</scrip" * 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = [(x.page_id, x.text, x.n_chars) for x in htmltext.extract_text(pages).collect()]
    texts = dict((k, t) for k, t, _ in found)
    assert len(found) == len(rows) and all(n == len(t) for _, t, n in found)
    assert texts[1] == want and texts[2] == texts[3] == texts[4] == texts[8] == "" and texts[5] == "just text" and texts[6] == "deep"


SENTENCES = "This is a long paragraph of the story with many words in it, that goes on and on for a while. " * 4


def test_regions_come_from_the_clusters(monkeypatch):
    """No telling tags or names: only the smoothed ratio finds the story."""
    label = lambda *words: "<div>" + " ".join(f"<span>{w}</span>" for w in words) + "</div>"
    above = "<div>" + label("Home", "News", "Sport") + label("Weather", "12", "C") + label("Top", "ten") + "</div>"
    below = "<div>" + "".join(label("Terms", "of", "use", "and", "Imprint", str(k)) for k in range(60)) + label("Jobs", "here") + "</div>"
    story = f"<div><div>{SENTENCES}</div><div>{SENTENCES}</div><div>Short one.</div><div>{SENTENCES}</div></div>"
    page = f"<body>{above}{story}{below}</body>"
    want = "\n".join([SENTENCES.strip(), SENTENCES.strip(), "Short one.", SENTENCES.strip()])
    assert htmltext.main_text(page) == want
    inside = f"<article><p>{SENTENCES}</p><p>{SENTENCES}</p>{below}</article>"
    assert htmltext.main_text(inside) == "\n".join([SENTENCES.strip()] * 2)
    monkeypatch.setattr(htmltext, "content_lines", lambda ratio: np.ones(len(ratio), bool))
    assert "Home" in htmltext.main_text(page) and "Jobs" in htmltext.main_text(page) and "Jobs" in htmltext.main_text(inside)


def test_doubtful_names_are_decided_by_the_clusters():
    lead, story = f"Lead. {SENTENCES}", SENTENCES
    page = f'<article><div class="story-header"><p>{lead}</p></div><p>{story}</p><div class="service-notice"><b>Sign</b> <i>up</i></div><p>{story}</p><div class="notice">{story}</div></article>'
    assert htmltext.main_text(page) == "\n".join([lead.strip(), story.strip(), story.strip()])


def test_long_and_deep_pages_take_linear_time():
    began = time.perf_counter()
    assert htmltext.main_text("<div>" * 40_000 + "<p>deep text") == "deep text"
    assert htmltext.main_text("<b><div>" + "<i>" * 40_000 + "</b>" * 40_000 + "deep text") == "deep text"
    assert htmltext.main_text("<article>" + "<p>one two" * 40_000).count("one two") == 40_000
    assert time.perf_counter() - began < 10
    assert htmltext.main_text("<article><p>" + "word " * 400_000) == ("word " * 400_000).strip()


# --- licenses


def brute_licenses(text):
    w, found = re.findall(licenses.WORD, (text or "").lower()), {}
    s = [" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
    by_name = {}
    for name, shingle in licenses.template_shingles(licenses.TEMPLATES):
        by_name.setdefault(name, set()).add(shingle)
    for name, own in by_name.items():
        c = 1 << (len(own) - 1).bit_length()
        best = max((len(own & set(s[k : k + 2 * c])) / len(own) for k in range(0, max(1, len(s)), c)), default=0)
        if best >= licenses.CONTAINMENT:
            found[name] = best
    return found


def test_licenses_equal_brute_force(spark):
    r = random.Random(7)
    filler = lambda n: " ".join(r.choice(["the", "license", "of", "work", "mit", "copy", "x", "under"]) for _ in range(n))
    rows = []
    for k, (_, text) in enumerate(list(licenses.TEMPLATES.items()) * 6):
        w = text.split()
        for _ in range(r.choice([0, 0, 1, 3, 12])):
            w[r.randrange(len(w))] = "changed"
        rows.append((k, f"{filler(r.randint(0, 80))} {' '.join(w).upper() if k % 2 else ' '.join(w)} {filler(r.randint(0, 80))}"))
    rows += [(900, None), (901, ""), (902, "no such thing"), (903, "x " * 50_000 + "Released under the MIT License."), (904, "Released under the MIT License."), (904, "Released under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hashes", F.lit("clash"))
    found = {(x.doc_id, x.license): x.containment for x in licenses.scan_licenses(docs).collect()}
    want = {(k, name): c for k, t in rows for name, c in brute_licenses(t).items()}
    missed = set(want) - set(found)
    assert not set(found) - set(want) and len(missed) <= 0.01 * len(want) and (903, "MIT statement") in found
    assert all(found[k] == pytest.approx(want[k]) for k in found)
    assert licenses.scan_licenses(docs.limit(0)).collect() == []


# --- leaks


def test_fingerprints_equal_counts():
    h = np.random.default_rng(1).integers(0, 2**63, 700).astype(np.uint64) * np.uint64(3)
    for w, prints in decontam.fingerprints(h, [1, 8, 64, 128, 512]).items():
        assert len(prints) == len(h) - w + 1
        for k in (0, 7, len(prints) - 1):
            want = sum(1 << b for b in range(64) if int(((h[k : k + w] >> np.uint64(b)) & np.uint64(1)).sum()) > w // 2)
            assert int(prints[k]) == want


def test_blocks_find_all_prints_within_the_radius():
    r = np.random.default_rng(2)
    index = decontam.Index([(k, " ".join(f"w{r.integers(300)}" for _ in range(40))) for k in range(30)]).open()
    theirs = index.windows[32][0]
    mine = np.concatenate([theirs, theirs ^ (np.uint64(1) << np.uint64(5)), theirs ^ (np.uint64(3) << np.uint64(40)), r.integers(0, 2**63, 500).astype(np.uint64)])
    a, b = index.near(32, mine)
    want = {(i, j) for i in range(len(mine)) for j in np.flatnonzero(np.bitwise_count(theirs ^ mine[i]) <= decontam.RADIUS)}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(i, int(j)) for i, j in want}


def test_leaks_are_found_and_clean_rows_stay(spark):
    r = random.Random(4)
    words_ = [f"v{k}" for k in range(500)]
    text = lambda n: [r.choice(words_) for _ in range(n)]
    items = [(k, " ".join(text(n))) for k, n in enumerate([1, 3, 5, 8, 15, 16, 17, 31, 33, 40, 60, 75, 90, 150, 300] * 3)] + [(900, None), (901, "")]
    rows, want = [], set()
    for k in range(400):
        own = text(r.randint(0, 120))
        if k % 2:
            item = r.choice(items[:45])
            w = item[1].split()
            if len(w) >= 60 and k % 4 == 1:
                w[r.randrange(len(w))] = "changed"  # one word: similarity is above 0.75
            own[r.randint(0, len(own)) :] = [*w, *text(r.randint(0, 60))]
            want.add((k, item[0]))
        rows.append((k, ("  ".join(own).upper() if k % 3 == 0 else " ".join(own))))
    rows += [(1000, None), (1001, ""), (None, rows[1][1]), (1, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id int, text string")
    found = decontam.find_leaks(docs, bench).collect()
    by_row = {(x.doc_id, x.item_id) for x in found}
    # short items also stand in texts by chance; every hit is checked against its own words
    assert want <= by_row
    texts = dict(rows)
    for x in found:
        if x.doc_id is not None and x.similarity == 1:
            assert re.findall(r"\w+", texts[x.doc_id][x.start : x.end].lower()) == dict(items)[x.item_id].split()
    flagged = {k for k, _ in by_row}
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(k for k, _ in rows if k not in flagged)
    assert decontam.find_leaks(docs, bench.limit(0)).collect() == [] and decontam.without_leaks(docs.limit(0), bench).collect() == []


def plain_best(item, text):
    """The greatest similarity of any span of the text, by trying all."""
    cut = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    bag, found, top = Counter(cut(item)), cut(text), 0.0
    for a in range(len(found)):
        held, common = Counter(), 0
        for b in range(a, min(len(found), a + bag.total() * 4 // 3 + 1)):
            held[found[b]] += 1
            common += held[found[b]] <= bag[found[b]]
            top = max(top, common / (bag.total() + b - a + 1 - common))
    return top


@pytest.mark.parametrize("seed", [1, 2])
def test_changed_items_equal_a_plain_scan(seed):
    """Words changed, put in, left out, cut off and parted by signs, at every similarity about the threshold."""
    r = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(300)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    found = wanted = 0
    for _ in range(250):
        item = text(r.choice([5, 8, 12, 16, 25, 33, 47, 64, 75, 95, 127, 200]))
        copy, n = list(item), len(item)
        for _ in range(r.randint(0, max(1, n // 24))):
            kind, k = r.choice(["change", "in", "out", "many in", "cut"]), r.randrange(len(copy))
            if kind == "cut":
                copy = copy[: max(5, len(copy) - r.randint(1, max(1, n // 8)))]
            else:
                copy[k : k + (kind in ("change", "out"))] = [] if kind == "out" else text(1 if kind in ("change", "in") else r.randint(2, max(2, n // 6)))
            if len(copy) < 5:
                copy = list(item)
        whole = text(r.randint(0, 30)) + copy + text(r.randint(0, 30))
        best = plain_best(item, whole)
        hits = list(decontam.Index([(7, " ".join(item))]).hits(pa.array([r.choice([" ", " \u2014 ", "\u00a0", ", "]).join(whole)])))
        assert (len(hits) == 1) == (best >= 0.75) and all(best >= h[2] >= 0.75 for h in hits)
        wanted += best >= 0.75
        found += bool(hits)
    assert wanted > 120 and found == wanted


def test_running_minima():
    r = np.random.default_rng(1)
    for _ in range(200):
        v, k = r.integers(-9, 9, r.integers(1, 30)), int(r.integers(1, 12))
        assert decontam.least_before(v, k).tolist() == [int(v[max(0, i - k) : i + 1].min()) for i in range(len(v))]


def test_leaks_in_long_and_repeating_texts():
    index = decontam.Index([(1, "again " * 50), (2, " ".join(f"v{k}" for k in range(40)))])
    began = time.perf_counter()
    hits = list(index.hits(pa.array(["again " * 60_000, "w " * 200_000 + " ".join(f"v{k}" for k in range(40)) + " w" * 200_000])))
    assert [(h[0], h[1], h[2]) for h in hits] == [(0, 0, 1.0), (1, 1, 1.0)] and time.perf_counter() - began < 20


# --- languages


def plain_viterbi(scores):
    n, k = scores.shape
    best = {s: (float(scores[0, s]), [s]) for s in range(k)}
    for i in range(1, n):
        best = {s: max(((v + float(scores[i, s]) - (langid.SWITCH if t != s else 0), [*path, s]) for t, (v, path) in best.items()), key=lambda x: x[0]) for s in range(k)}
    return max(best.values(), key=lambda x: x[0])


def test_viterbi_and_its_short_cut():
    r = np.random.default_rng(5)
    for n in (1, 2, 30, 80):
        for scale in (0.5, 3, 9):
            drift = np.repeat(r.standard_normal((max(1, n // 10), 4)), 10, axis=0)[:n]
            scores = (r.standard_normal((n, 4)) + drift[:n] if len(drift) >= n else r.standard_normal((n, 4))) * scale
            value = lambda path, s=scores, n=n: sum(s[np.arange(n), path]) - langid.SWITCH * (np.diff(path) != 0).sum()
            top = plain_viterbi(scores)[0]
            assert value(langid.viterbi(scores)) == pytest.approx(top) and value(langid.labelled(scores)) == pytest.approx(top)


def test_short_cut_never_differs_from_viterbi():
    """Two languages may each hold a part of a text whose best sum is a third one's."""
    assert langid.labelled(np.array([[0, -20, -9.9], [-20, 0, -9.9]])).tolist() == [0, 1]
    r = np.random.default_rng(10)
    for _ in range(20_000):
        scores = -r.random((r.integers(1, 8), r.integers(1, 5))) * r.choice([3, 8, 12, 25])
        value = lambda path, s=scores: s[np.arange(len(s)), path].sum() - langid.SWITCH * (np.diff(path) != 0).sum()
        assert value(langid.labelled(scores)) == pytest.approx(value(langid.viterbi(scores)), abs=1e-9)


def test_scripts_by_code_point():
    pairs = {"a": 0, "é": 0, "ế": 0, "ﬁ": 0, "α": 1, "ἀ": 1, "ж": 2, "ꙁ": 2, "א": 3, "ա": 3, "ع": 4, "क": 5, "ไ": 5, "ខ": 5, "ა": 6, "አ": 6, "한": 7, "ᄀ": 7, "漢": 8, "か": 8, "𠀀": 8, "ᚠ": 9, "𐌰": 9}
    data = np.frombuffer("".join(pairs).encode(), np.uint8)
    assert langid.scripts_at(data, np.flatnonzero((data & 0xC0) != 0x80)).tolist() == list(pairs.values())
    assert langid.normal("„Één—twee…”") == " één twee  "


def test_languages(spark):
    r = random.Random(6)
    syllables = {"xx": ["ka", "to", "mi", "ru"], "yy": ["sch", "ung", "keit", "ver"], "zz": ["при", "вет", "мир", "да"]}
    word = lambda lang: "".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4)))
    rows = [(k, " ".join(word(lang) for _ in range(r.randint(3, 60))), lang) for k in range(300) for lang in [r.choice(list(syllables))]]
    mixed = " ".join([*(word("xx") for _ in range(40)), *(word("yy") for _ in range(12))])
    rows += [(900, None, "xx"), (901, "", None), (902, "123 --", "yy"), (903, mixed, None), (903, mixed, None), (904, "ka" * 60_000, None), (None, "kato miru", "xx"), (905, "KATO MIRU TOKA", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    found = langid.with_language(docs).collect()
    assert len(found) == len(rows)
    by_id = {x.doc_id: x for x in found}
    for k, _, lang in rows[:300]:
        assert by_id[k].lang_pred == lang and by_id[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0.9 < by_id[k].score <= 1
    assert all(by_id[k].lang_pred == langid.UND and by_id[k].score == 0 for k in (900, 901, 902))
    assert by_id[903].lang_pred == "xx" and 0.4 < by_id[903].score < 0.9 and by_id[905].lang_pred == "xx"
    model = langid.learn(docs)
    spans = next(langid.predict(model, pa.array([mixed])))[3]
    assert [s[0] for s in spans] == ["xx", "yy"] and abs(spans[0][2] - 40) <= 1
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert langid.with_language(docs.limit(0)).collect() == []


def test_letters_of_no_known_language(spark):
    r = random.Random(8)
    syllables = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "keit", "ver"], "cc": ["lö", "pä", "qy", "wex"], "dd": ["zo", "fij", "hag", "dé"], "ee": ["nub", "xol", "gip", "jas"]}
    text = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(k, text(lang, 40), lang) for k in range(400) for lang in [r.choice(list(syllables))]]
    foreign = ["Сегодня новый закон", "政府今天批准了一项新的法律，保护公民。", "«Привет», мир", "，政府今天", "ⲁⲃⲅ ⲇⲉ", "kato Сегодня правительство одобрило новый закон"]
    known = [" ".join(text(lang, 20) for lang in syllables), "kato miru toka 政府", "“kato” — miru 😀😀😀😀😀😀😀😀😀😀"]
    rows += [(1000 + k, t, None) for k, t in enumerate(foreign)] + [(2000 + k, t, None) for k, t in enumerate(known)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(x.doc_id for x in langid.accepted(docs).collect()) == [*range(400), *range(2000, 2000 + len(known))]
    found = {x.doc_id: x for x in langid.with_language(docs).collect()}
    assert all((found[1000 + k].lang_pred, found[1000 + k].score) == (langid.UND, 0) for k in range(5))
    assert found[1005].lang_pred == "aa" and found[1005].score < 0.2 and found[2001].score == pytest.approx(12 / 14) and found[2002].score == 1


def test_words_of_mostly_unseen_ngrams():
    r = np.random.default_rng(9)
    some = ["".join(chr(97 + x) for x in r.integers(0, 13, r.integers(2, 9))) for _ in range(3000)]
    data = np.frombuffer(" ".join(some).encode(), np.uint8)
    start, end, _ = words(data, np.array([0, len(data)]), langid.LETTERS)
    seen = np.zeros(1 << langid.BITS, bool)
    seen[langid.ngrams(data, start, end)[0]] = True
    scripts = np.zeros((langid.SCRIPTS, 1), bool)
    scripts[0] = True
    model = langid.Model(["xx"], np.zeros((1 << langid.BITS, 1), np.float32), scripts, seen)
    shares = [x[4] for x in langid.predict(model, pa.array([" ".join(some[:20]), "zwxy vyst zxyst wzrt", f"{some[0]} {'z' * len(some[0])}"]))]
    assert seen.sum() > langid.ENOUGH and shares == [1, 0, 0.5]


def test_words_of_letters_and_digits():
    _, data, offsets = next(pieces(pa.array(["Ab, cd!! é1", "ab CD"])))
    start, end, bounds = words(data, offsets, ALNUM)
    h = word_hashes(data, start, end)
    assert bounds.tolist() == [0, 3, 5] and h[0] == h[3] and h[1] == h[4]


def test_leak_index_without_items():
    """No items, or items without words, hold nothing and leave the others alone."""
    texts = pa.array([None, "", "x y one two three four five six seven z"])
    assert list(decontam.Index([]).hits(texts)) == []
    assert [h[:2] for h in decontam.Index([(1, " "), (2, "one two three four five six seven")]).hits(texts)] == [(2, 1)]
