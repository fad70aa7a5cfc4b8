"""Operators of the training-data subpackage against brute force, on small and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, html_text, langid, pii, quality, registry, rules, sentencepieces, simhash, token_counts, warc
from tidelog.llm.components import components

SF = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, hash string, fp string"
ODD = [(1, "The cat sat on the mat.", "en"), (1, "The cat sat on the mat.", "en"), (None, "Der Hund", "de"), (2, None, None), (3, "", "en"), (4, " \n\t", None), (5, "word " * 3000, "en"), (6, "x" * 50_000, "en"), (7, "éàü ß 日本 🙂 ▁ a|b", "fr")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and further columns with names that the plans use."""
    return spark.createDataFrame([(*r, "s", 1, "w", "h", "f") for r in ODD], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


# personal data


def brute_pii(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{s}:{e}" for k, s, e in found]


def test_pii(spark, small, odd):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a", "@", ".", "1", "25", "+1", " ", "-", "é", "(", "4111111111111111", "mail", "b.c"]) for _ in range(40))) for i in range(600)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (made, small):
        texts = texts_of(df)
        for r in pii.detect(df).collect():
            want = brute_pii(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert Counter(x.split(":")[0] for x in want) == +Counter({"email": r.n_email, "ip": r.n_ip, "card": r.n_card, "phone": r.n_phone})
            assert [x for x in r.spans.split(",") if x.split(":")[0] in pii.BASE_KINDS] == want
    assert pii.detect(odd).count() == len(ODD) and pii.detect(odd.limit(0)).count() == 0


def test_pii_kinds_and_redaction(spark):
    text = 'IBAN DE89 3704 0044 0532 0130 00, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962", a@b.de, DE00 3704 0044 0532 0130 00'
    assert [s[0] for s in pii.find_spans(text.encode())] == ["email", "iban", "secret"]
    assert pii.find_spans(b"04dbebab91ab85687d33eeaaf9ac699e1188f962") == []  # no context
    df = spark.createDataFrame([("mail a@b.de now",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(pii.redact(F.col("text"))).collect()] == ["mail <email> now", None, ""]
    assert pii.find_spans(b"1" * 200_000 + b"." + b"a" * 200_000 + b"@") == []


# near-duplicates


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum((2 * n > len(grams)) << b for b, n in enumerate(bits))


def brute_components(fps):
    left, out = dict(fps), {}
    while left:
        todo = [min(left)]
        group = set()
        while todo:
            i = todo.pop()
            if i in left:
                f = left.pop(i)
                group.add(i)
                todo += [j for j, g in left.items() if (f ^ g).bit_count() <= 3]
        out |= dict.fromkeys(group, min(group))
    return out


def test_simhash(spark, small, odd, monkeypatch):
    fps = {i: brute_fingerprint(t) for i, t in texts_of(small).items()}
    want = brute_components(fps)
    for group in (simhash.GROUP, 8):  # the second splits groups into pairs of chunks
        monkeypatch.setattr(simhash, "GROUP", group)
        got = simhash.near_duplicates(small).collect()
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.fingerprint == "0" * 16} == {2}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_links(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(6)} | {0, 1, 2**64 - 1}
    want = brute_components({f: f for f in fps})
    signed = lambda f: f - 2**64 if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    groups = lambda pairs: {frozenset(a for a, b in pairs if b == root) for root in {b for _, b in pairs}}
    for dealt_by in (None, (4, 0), (4, 5), (4, 16), (5, 24), (6, 30)):
        found = {r.node: r.root for r in components(simhash.linked_edges(df, 3, dealt_by)).collect()}
        assert groups([(signed(f), found.get(signed(f), signed(f))) for f in fps]) == groups([(signed(f), signed(want[f])) for f in fps])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 99), (100, 98)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {98: 98, 99: 98, 100: 98}


# decontamination


def brute_contamination(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(13, len(w))
        spans = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(doc) - n + 1) if w else ():
            if tuple(doc[i : i + n]) in spans:
                hit |= set(range(i, i + n))
                found.add("null" if item is None else str(item))
    return len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(doc)


@pytest.mark.parametrize("short", [False, True])
def test_contamination(spark, odd, short):
    rng = random.Random(7)
    some = lambda n, of="abcdefgh": [rng.choice(of) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([13, 20, 40]), ["É", "é", "The", "ab", "cd", "e1"]))) for i in range(8)] + [(9, None), (10, " "), (3, "a b c")] * short
    items += [(11, "Zz"), (None, "k k2 k3 k4 k5"), (12, "a b a")] * short
    docs = []
    for i in range(60):
        words = some(rng.randrange(60))
        _, t = rng.choice(items)
        piece = (t or "").split()
        at = rng.randrange(max(1, len(piece) - 5))
        docs.append((i, " ".join([*words, *piece[at : at + rng.choice([5, 12, 13, 30])], *some(9)]).replace("the", rng.choice(["The", "the"]))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: brute_contamination(t, items) for i, t in docs}
    rows = decontaminate.contamination(odd, odd.limit(2), item_col="doc_id").collect()
    assert len(rows) == len(ODD) and sorted(r.n_hit for r in rows) == [0] * 7 + [6, 6]
    assert decontaminate.contamination(odd, odd.limit(0), item_col="doc_id").where("n_hit > 0").count() == 0


# languages, quality, rules


def test_language(spark, odd):
    docs = spark.read.parquet(f"{SF.parent}/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and not any(r.rejected for r in rows)
    model = langid.Model({"en": langid._grams(Counter("the cat sat on the mat".split())), "de": langid._grams(Counter("der hund und die katze".split()))})
    for words in (["the", "hund", "", "q"], ["ttt"]):
        sums, n = model.words(words)
        for w, s, k in zip(words, sums, n):
            assert k == (len(w) + 1 if w else 0) and (s <= 0).all()
    total = sum(2.718281828459045 ** float(model.words([c])[0][0, 1]) for c in "thecatsonmdruigkz")
    assert total < 1  # shares of single letters followed by an end
    got = langid.identify(odd).collect()
    assert len(got) == len(ODD) and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (2, 3, 4))
    assert langid.identify(odd.limit(0)).count() == 0 and langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_languages_not_learned_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where("lang <> 'fr'"))
    rows = docs.where(langid.held_out(F.col("doc_id")) | F.expr("lang = 'fr'")).select("lang", langid.predict(F.col("text"), model).alias("x")).where("x.lang_pred <> 'und'").select("lang", "x.rejected").collect()
    known, foreign = [r.rejected for r in rows if r.lang != "fr"], [r.rejected for r in rows if r.lang == "fr"]
    assert not any(known) and len(known) > 100
    assert sum(foreign) >= 0.95 * len(foreign) and len(foreign) > 100


@pytest.mark.parametrize("part", [langid.PART, 700])
def test_model_by_joins(spark, monkeypatch, part):
    monkeypatch.setattr(langid, "PART", part)  # the second makes many files of ranges
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counted = langid.gram_counts(docs).collect()
    counts = {}
    for lang, gram, n in counted:
        counts.setdefault(lang, {})[gram] = n
    want, got = langid.Model(counts), langid.build(langid.gram_counts(docs))
    assert (got.parts > langid.RANGES) == (part == 700)
    words = ["the", "wurde", "é", "", "zzzzqx", "données", *{langid.letters(t) for r in docs.limit(20).collect() for t in r.text.split()}]
    assert got.langs == want.langs and (got.words(words)[1] == want.words(words)[1]).all()
    assert abs(got.words(words)[0] - want.words(words)[0]).max() < 1e-3


def test_large_alphabet_leaves_rare_language(spark):
    """More n-grams than 500,000, each more frequent than those of the rare language."""
    rng = random.Random(0)
    many = [" ".join("".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(10)) for _ in range(1000)) for _ in range(60)]
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5]
    rare = "quokka numbat bilby dunnart potoroo"
    rows = [(i, t, "zh") for i, t in zip(ids, many + many)] + [(ids[-1], rare, "au"), (ids[-2], "hello there my friend " * 3, "en")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["au", "en", "zh"]
    assert langid.Scorer(model).texts([rare])[0][0] == "au"


def test_limits_of_all_training_texts(spark):
    """A language of two among 4,000 texts has a limit, as has one that no training text was given."""
    ids = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 5][:4000]
    place = lambda i: int.from_bytes(xxhash.xxh64_digest(i.to_bytes(8, "little"), 42), signed=True)
    rare = set(sorted(ids, key=place)[-2:])  # not among those of least hash
    rows = [(i, "quokka numbat bilby dunnart potoroo" if i in rare else f"the cat sat on the mat {i % 7}", "au" if i in rare else "en") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["au", "en"] and all(0 < x < float("inf") for x in model.limits)
    assert [x[3] for x in langid.Scorer(model).texts(["quokka numbat", "zzq qqk kkq qzk"])] == [False, True]
    got = langid.set_limits(model, spark.createDataFrame([("en", 2.0), ("en", 2.0)], "lang_pred string, cross_entropy double"))
    assert abs(got.limits - 2 * langid.MARGIN).max() < 1e-3
    assert not any(r.rejected for r in langid.identify(docs).collect())


def test_quality(spark, odd):
    docs, labels = (spark.read.parquet(f"{SF.parent}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in rows) >= 0.9 * len(rows)
    none = labels.limit(0)
    assert {r.score for r in quality.classify(odd, none).collect()} == {0.5} and quality.classify(odd.limit(0), labels).count() == 0
    assert quality.classify(odd, labels).count() == len(ODD)


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, small, odd, monkeypatch):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = rules.apply_rules(small, labels).collect()
    texts = texts_of(small)
    for r in rows:
        assert tuple(r[1:6]) == brute_statistics(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    long = [t for t in texts.values() if len(t.split()) > 20]
    want = [rules.repeated_words(t.encode().split()) for t in long]
    monkeypatch.setattr(rules, "LONG", 0)
    assert [rules.repeated_words(t.encode().split()) for t in long] == want
    good = small.join(labels.where("quality = 1"), "doc_id").select("doc_id")
    kept = rules.apply_rules(small, labels).join(good, "doc_id").where("not base_failed")
    assert kept.where("kept").count() >= 0.95 * kept.count()
    assert rules.apply_rules(odd, labels.limit(0)).where("not base_failed and not kept").count() == 0
    assert rules.apply_rules(odd, labels).count() == len(ODD) and rules.apply_rules(odd.limit(0), labels).count() == 0


# pages


def test_html(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a>Menu</a></nav>
    <div class="cookie-notice">Cookies</div><article><h1>Title &amp; more</h1><p>Some <b>bold</b> text
    goes on for a good while here.<p>Short.<script>x("</p>")</script><div class="ad">Buy</div><form>Name</form>
    <p>Last paragraph of it.</article><section id="comments"><p>Nice post, thanks a lot for it!</p></section><footer>&copy;</footer>"""
    assert html_text.main_text(page) == "Title & more Some bold text goes on for a good while here. Short. Last paragraph of it."
    loose = re.sub("</?article>", "", page)
    assert "Last paragraph of it." in html_text.main_text(loose) and "Menu" not in html_text.main_text(loose)
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "u", ""), (3, "u", "a" * 300_000), (4, "u", "</p></div><"), (5, "u", "<nav>x</nav>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == sorted([(1, 87), (1, 87), (0, 0), (2, 0), (3, 300_000), (4, 1), (5, 0)]) and all(r.n_chars == len(r.text) for r in got)


def test_html_ratios_choose_in_landmarks():
    long = "A sentence of the text that goes on for a good while, as they do. " * 4
    links = "".join(f"<div><span><a href='/{i}'><b>Link {i}</b></a></span></div>" for i in range(12))
    one = html_text.main_text(f"<body><article><p>{long}</p><p>Short.</p><p>{long}</p>{links}</article>")
    assert "Short." in one and one.count("A sentence") == 8 and "Link 9" not in one
    both = html_text.main_text(f"<body><main><p>Introduction. {long}</p><article><p>First. {long}</p></article><article><p>Second. {long}</p><article><p>Nested. {long}</p></article></article></main>")
    assert all(w in both for w in ("Introduction.", "First.", "Second.", "Nested."))


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "layout has-sidebar", "no-sidebar", "post-with-comments", "page-header-wrapper", "sidebar"])
def test_html_names_of_wrappers(name):
    long = "A sentence of the text that goes on for a good while, as they do. " * 4
    for tag in ("article", "section"):
        assert html_text.main_text(f"<body><div class='{name}'><{tag}><p>{long}</p></{tag}></div><div class='social'>Follow us</div></body>") == long.strip()
    both = html_text.main_text(f"<body><article><p>{long}</p></article><div id='comments'><article><p>{long} Nice.</p></article></div></body>")
    assert both == long.strip()
    assert html_text.main_text(f"<div class='widget'>{long}</div><div class='tags'>{long}</div>")


@pytest.mark.parametrize("version", [1, 2])
def test_warc(spark, version):
    rows = [(1, "http://a b/é", "<p>x"), (2, None, "<p>x"), (2, "v", "<p>x"), (None, "u", None), (3, "u", ""), (4, "q", "a\r\n\r\nb é"), (None, "n", "only")]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), version).collect()
    assert sorted(map(repr, ((r.page_id, r.url, r.payload_bytes) for r in got))) == sorted(map(repr, ((i, u, len((h or "").encode())) for i, u, h in rows)))
    kinds = Counter((r.payload_digest, r.record_type) for r in got)
    assert all(kinds[d, "response"] == 1 for d, _ in kinds)
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {2, 3} and all(r.page_id in (1, 2, None) for r in got if r.record_type == "revisit")
    apart = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), version, least=10**6).collect()
    assert all(r.record_type == "response" for r in apart)
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), version).count() == 0


# tokens


def test_sentencepiece(spark, small, odd):
    import sentencepiece

    data, public = sentencepieces.load(), sentencepiece.SentencePieceProcessor(model_file=sentencepieces.PATH)
    rng = random.Random(1)
    texts = [*texts_of(small).values(), "", " ", "a" * 2000, " x  y ", *("".join(rng.choice("ab  \n\t ▁é日🙂thein<0>") for _ in range(rng.randrange(50))) for _ in range(500))]
    model = sentencepieces.Model(data)
    for t in texts:
        ids = sentencepieces._ids(model.encode(t)).tolist()
        assert ids == public.encode(t) and model.decode(ids).decode() == t.replace("▁", " ")
    rows = sentencepieces.encode_decode(odd, data).collect()
    assert len(rows) == len(ODD) and all(r.round_trip for r in rows)
    back = odd.select("text", sentencepieces.encode(F.col("text"), data).alias("ids")).select("text", sentencepieces.decode(F.col("ids"), data).alias("back")).collect()
    assert all(r.back == (r.text or "").replace("▁", " ") for r in back)


def test_unigram():
    message = lambda n, body: bytes([n << 3 | 2, len(body)]) + body
    import struct

    pieces = [("<unk>", 0.0, 2), *((c, -5.0, 1) for c in "▁ab"), ("▁a", -3.0, 1), ("ab", -2.0, 1), ("aba", -9.0, 1)]
    data = b"".join(message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k])) for p, s, k in pieces) + message(2, b"\x18\x01") + message(3, b"\x20\x00")
    model = sentencepieces.Model(data)
    best = {}

    def brute(text):
        if not text:
            return 0.0, []
        if text not in best:
            best[text] = max((s + brute(text[len(p) :])[0], [i, *brute(text[len(p) :])[1]]) for i, (p, s, k) in enumerate(pieces) if k == 1 and text.startswith(p))
        return best[text]

    for text in ("ab", "aba", "abab", "ba ab"):
        ids = sentencepieces._ids(model.encode(text)).tolist()
        score, _ = brute("▁" + text.replace(" ", "▁"))
        assert sum(pieces[i][1] for i in ids) == score


def test_token_counts(spark, small, odd):
    model = sentencepieces.load()
    for df in (small, odd):
        encoder, want = sentencepieces.Model(model), Counter()
        docs = Counter()
        for r in df.select("source", "lang", "text").collect():
            if n := len(encoder.encode(r.text or "")) // 4:
                want[r.source, r.lang] += n
                docs[r.source, r.lang] += 1
        got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in token_counts.maintain(df, model).collect()}
        assert got == {k: (docs[k], n) for k, n in want.items()}


def test_rollup(spark, tmp_path):
    rollup = token_counts.Rollup(spark, (tmp_path / "r").as_uri())
    docs = spark.createDataFrame([("a", "en", 5), ("a", "en", 7), (None, None, None)], "source string, lang string, n long")
    record = token_counts.record("source", "lang", F.lit("v1"), "n")
    totals = lambda: {(r.source, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert totals() == {} and rollup.commit("1", token_counts.inserts(docs, record)) and not rollup.commit("1", token_counts.inserts(docs, record))
    assert totals() == {("a", "v1"): (2, 12), (None, "v1"): (1, 0)}
    rollup.commit("2", token_counts.revisions(docs.where("n = 5"), record, token_counts.record("source", "lang", F.lit("v2"), F.lit(9))))
    rollup.commit("3", token_counts.deletes(docs.where("n is null"), record))
    want = {("a", "v1"): (1, 7), ("a", "v2"): (1, 9)}
    assert totals() == want
    rollup.compact()
    assert totals() == want and not rollup.commit("2", token_counts.inserts(docs, record))
    assert rollup.commit("4", token_counts.inserts(docs.limit(0), record)) and totals() == want


# pipeline and queries


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got, want = registry.queries()[name](spark, str(SF)).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_without(spark, monkeypatch):
    from tidelog.llm import idset

    rows = spark.createDataFrame([(i, f"t{i}") for i in [*range(300), 7, 8]] + [(None, "n")], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 300, 7)] + [(None,), (7,)], "doc_id long")
    for bits in (1 << 24, 64):  # the second shares most bits
        monkeypatch.setattr(idset, "BITS", bits)
        got = Counter(r.doc_id for r in idset.without(rows, ids).collect())
        assert got == Counter(i for i in [*range(300), 8] if i % 7)
        assert Counter(r.doc_id for r in idset.fetched(rows, ids).collect()) == Counter([*range(0, 300, 7), 7, None])
        pair = rows.withColumnsRenamed({"text": "row"}).withColumn("maybe", F.lit(1)).withColumn("bit", F.lit(2))
        assert idset.without(pair, pair.select("doc_id", "row").where("doc_id is null or doc_id = 7")).columns == pair.columns
        assert idset.without(pair, pair.select("doc_id", "row").where("doc_id is null or doc_id = 7")).count() == 300
        assert idset.without(pair, ids.limit(0)).count() == 303 and idset.without(pair.limit(0), ids).count() == 0
