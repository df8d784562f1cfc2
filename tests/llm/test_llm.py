"""The ten operators and the pipeline against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict, namedtuple

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import embeddings, html_text, language_id, mixing, near_copies, packing, quality, simhash, substrings, toxicity, warc_fixity
from quarry.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
Document = namedtuple("Document", "doc_id source text")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
EXTRA = ["words", "size", "fp", "node", "_rest", "_row", "bucket", "label", "_block", "_doc", "_first", "component_id", "virtual_finish", "target"]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def awkward(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a long text, digits only, other scripts."""
    passage = "one passage of well over fifty bytes that several documents of this little table share, word for word"
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, "the cat sat on the mat and the dog", "en", "a", 34), (4, "the cat sat on the mat and the dog", "en", "a", 34),
        (None, "the cat sat on the mat and the dog", "en", "b", 34), (5, "1234 5678 !!", None, "b", 12), (6, passage, "en", "b", len(passage)), (7, "Zuerst: " + passage + " und Schluß", "de", "c", 0),
        (8, "wort " * 40000 + passage, "de", "c", 200000), (9, "Привет, мир ελληνικά 日本語", None, "c", 0), (10, "naïve café é è " + passage + "é", "fr", "d", 0), (11, "x", "en", "d", 1), (11, "y", "en", "d", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(k) for k, c in enumerate(EXTRA)}).withColumn("a.b", F.lit("dotted")).withColumn("tick`", F.lit(1))


def tables(spark):
    return {"awkward": awkward(spark), "empty": awkward(spark).limit(0), "documents": documents(spark)}


@pytest.fixture(scope="module", params=["awkward", "empty", "documents"])
def docs(request, spark):
    return tables(spark)[request.param]


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


# 1. Language ID


def plain_grams(text):
    chars = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    found = Counter()
    for word in chars.split():
        found.update(word)
        padded = f" {word} "
        for n in (2, 3):
            found.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return found


def gram_key(g):  # single characters, then pairs, before triples, which have the sign bit
    return (0 if len(g) == 3 else len(g), [ord(c) for c in g]) if len(g) < 3 else (-1, [ord(c) for c in g])


def plain_profile(counts):
    return sorted(counts, key=lambda g: (-counts[g], gram_key(g)))[: language_id.PROFILE_SIZE]


def test_language_against_plain(spark, docs):
    rows = docs.collect()
    learned = defaultdict(Counter)
    for r in rows:
        if r.lang is not None and not held(r.doc_id):
            learned[r.lang].update(plain_grams(r.text))
    profiles = {lang: {g: k for k, g in enumerate(plain_profile(c))} for lang, c in learned.items()}

    def predict(text):
        own = plain_profile(plain_grams(text))
        if not own or not profiles:
            return "und", 0.0
        most = language_id.PROFILE_SIZE
        off = {lang: sum(abs(k - p[g]) if g in p else most for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(off), key=off.get)
        return best, round(1 - off[best] / (most * len(own)), 9)

    expected = sorted((str(r.doc_id), held(r.doc_id), *predict(r.text)) for r in rows)
    found = sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 9)) for r in language_id.identify(docs).collect())
    assert found == expected


def test_every_label_can_be_predicted(spark):
    rng = random.Random(8)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    rows = [(3 * k, " ".join("".join(rng.choices(letters[3 * (k % 300) : 3 * (k % 300) + 3], k=4)) for _ in range(20)), f"l{k % 300:03d}") for k in range(3000)]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    labels = {d: lang for d, _, lang in rows}
    assert sum(r.lang_pred == labels[r.doc_id] for r in found) >= 0.99 * len(rows) and len({r.lang_pred for r in found}) == 300


def test_language_held_out_accuracy(spark):
    joined = language_id.identify(documents(spark)).join(documents(spark).select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in joined) >= 0.97 * len(joined)


def test_language_parts_of_long_texts(monkeypatch):
    text = "a long text of words, " * 50
    whole = [x.tolist() for x in language_id.grams(text)]
    monkeypatch.setattr(language_id, "PART", 7)
    assert [x.tolist() for x in language_id.grams(text)] == whole


def test_language_rejects_only_texts_without_letters(spark, docs):
    kept = language_id.reject_unidentified(docs)
    assert kept.columns == docs.columns
    if any(r.lang for r in docs.collect()):
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in docs.collect() if any(c.isalpha() for c in r.text or "") and "Привет" not in r.text)


# 2. Mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * rest > most * sizes[s] * total}
        if not above:
            target |= {s: weight[s] * rest / total for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in above}
        rest -= sum(most * sizes[s] for s in above)
        open_ -= above
    return target


def stream_of(docs):
    rows, buckets = mixing.numbered(docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("_row")))
    return mixing.mix_stream(rows, buckets=buckets).collect()


def plain_queue(rows, target):
    """(finish, source's place, words, doc_id) of all packets in the order of virtual finish."""
    names = sorted((s for s in target if s is not None), key=lambda s: s.encode()) + ([None] if None in target else [])
    queue = []
    for place, source in enumerate(names):
        own = [r for r in rows if r.source == source]
        own.sort(key=lambda r: (hashlib.md5(f"mix:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), r.doc_id is not None, r.doc_id or 0, len(plain_words(r.text))))
        at, size, served = 0, sum(len(plain_words(r.text)) for r in own), math.floor(target[source])
        for turn in range(3):
            for r in own:
                start, at = at, at + len(plain_words(r.text))
                if turn == 0 or start < at and start < target[source]:
                    ends = [served, at] if start < served < at else [at]
                    for a, b in zip([start, *ends], ends):
                        queue.append((b / target[source] if target[source] else 0.0, place, a, b - a, str(r.doc_id)))
    return sorted(queue)


def test_mix_against_plain(spark, docs):
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(plain_words(r.text))
    target = plain_targets(sizes) if rows else {}
    found = mixing.mix(docs).collect()
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(r.doc_id), len(plain_words(r.text))) for r in rows)
    assert all(r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) for r in found)
    assert all(0 <= r.taken <= 3 * r.size for r in found)
    taken, budget, at = Counter(), sum(sizes.values()), 0
    for _, _, _, words, key in plain_queue(rows, target):
        taken[key] += max(0, min(words, budget - at))
        at += words
    by_id = Counter()
    for r in found:
        by_id[str(r.doc_id)] += r.taken
    assert +by_id == +taken and sum(by_id.values()) == budget
    by_source = Counter()
    for r in found:
        by_source[r.source] += r.taken
    assert all(abs(by_source[s] - target[s]) <= len(target) for s in target)
    assert sorted(map(str, mixing.mix(docs.repartition(3)).collect())) == sorted(map(str, found))


def test_mix_takes_the_prefix_by_virtual_finish(spark):
    rows = sorted((r for r in stream_of(documents(spark)) if r.size_to > r.size_from), key=lambda r: (r.range_no, r.mix_offset))
    at, budget = 0, sum(len(plain_words(r.text)) for r in documents(spark).collect())
    for r in rows:
        size = r.size_to - r.size_from
        assert r.mix_offset == at and r.words == max(0, min(size, budget - at))
        at += size
    finish = [r.virtual_finish for r in rows]
    assert finish == sorted(finish) and any(not r.words for r in rows)
    plan = mixing.op2(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "virtual_finish" in plan and "range_no" in plan and "mix_offset" in plan


def test_empty_documents_are_in_no_window(spark):
    df = spark.createDataFrame([(k, None if k % 2 else "a b c", "s") for k in range(200)], "doc_id long, text string, source string")
    found = mixing.mix(df).collect()
    assert sum(r.taken for r in found) == 300 and all(r.taken == 0 for r in found if not r.size)


def test_reruns_agree_where_ids_repeat(spark):
    rows = [(k % 7, f"{chr(97 + k % 5)} text of {k}", "ab"[k % 2]) for k in range(60)]
    schema, runs = "doc_id long, text string, source string", []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        runs.append(sorted(map(str, mixing.mixed_documents(spark.createDataFrame(rows, schema).repartition(3 + seed)).collect())))
    assert runs[0] == runs[1]


def test_mixed_documents_are_cut_to_the_words_taken(spark, docs):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    total = sum(len(plain_words(r.text)) for r in mixed.collect())
    assert total == sum(r.words for r in stream_of(docs))
    whole = {r.text for r in docs.collect()}
    assert all(r.text in whole or any((w or "").startswith(r.text) for w in whole) for r in mixed.collect())


# 4. Substrings


def plain_cut(rows, width=50):
    seen = {}
    for r in sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id):
        b = (r.text or "").encode()
        for p in range(len(b) - width + 1):
            seen.setdefault(b[p : p + width], r.doc_id)
    out = []
    for r in rows:
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if r.doc_id is not None and seen[b[p : p + width]] < r.doc_id:
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((str(r.doc_id), len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found_cut(docs):
    return sorted((str(r.doc_id), r._n_bytes, r._n_removed, r._n_spans, r._kept_sha256) for r in substrings.cut_repeats(docs).collect())


def test_cut_against_plain(spark, docs):
    assert found_cut(docs) == plain_cut(docs.collect())


def test_cut_random_texts_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", (400, 400))
    monkeypatch.setattr(substrings, "RANGE_BYTES", 300)
    monkeypatch.setattr(substrings, "SEGMENT", 64)
    rng = random.Random(5)
    pool = ["".join(rng.choice("abé ") for _ in range(rng.randint(30, 120))) for _ in range(12)] + ["a" * 90, "ab" * 60]
    rows = [(k, "".join(rng.choice(pool) for _ in range(rng.randint(0, 4))) + rng.choice(["", "z", "é"])) for k in rng.sample(range(1000), 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_cut(df) == plain_cut(df.collect())


def test_cut_documents_keep_their_columns(spark, docs):
    cut = substrings.without_repeats(docs)
    assert cut.columns == docs.columns and cut.schema == docs.schema
    assert cut.filter("text is null").count() == docs.filter("text is null").count()


def test_equal_keys_of_different_contexts(monkeypatch):
    rng = np.random.default_rng(3)
    c = rng.integers(97, 99, (300, substrings.CONTEXT)).astype(np.uint8)
    c[:, : substrings.GRAM] = 97
    c[:, substrings.WIDTH + substrings.LEFT], c[:, substrings.WIDTH + substrings.LEFT + 1] = substrings.WIDTH, substrings.LEFT
    c[:, 25:50] = c[:, 25:26]
    ids = rng.integers(0, 50, 300)
    right = substrings.repeated(c, ids)
    monkeypatch.setattr(substrings, "mixed", lambda x: x * np.uint64(0))
    assert (substrings.repeated(c, ids) == right).all() and right.any()


# 5. Packing


def test_contexts_take_memory_by_slices(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh ", k=2000)) for _ in range(200)]
    block = substrings.Block(np.arange(400), np.ones(400, dtype=bool), pa.array([t.encode() for t in texts * 2]))
    every = np.arange(len(block.at))
    expected = block.contexts(every)
    monkeypatch.setattr(substrings, "AT_ONCE", 1000)
    tracemalloc.start()
    found = block.contexts(every)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 * len(every) and all((a == b).all() for a, b in zip(found, expected))
    assert len(found[0]) < len(every) and (found[0][found[2]][:, -2] == np.minimum(block.bounds[1:][block.doc] - block.at, 50)).all()


def test_pack_round_trip(spark, docs):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = docs.collect()
    expected = Counter((str(r.doc_id), tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in rows)
    pieces = packing.pack(docs, TOKENIZER, with_ids=True).collect()
    windows, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        windows[p.sequence_id].append((p.offset, p.length))
        by_doc[str(p.doc_id)].append(p)
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0 and at < 4096
    for key in {k for k, _ in expected}:
        wanted = sorted(ids for (k, ids), n in expected.items() for _ in range(n) if k == key)
        assert sum(p.length for p in by_doc[key]) == sum(map(len, wanted))
        if len(wanted) == 1:
            own = sorted(by_doc[key], key=lambda p: p.start)
            assert tuple(i for p in own for i in p.ids) == wanted[0] and all(p.doc_tokens == len(wanted[0]) for p in own)


def test_fill_is_a_closest_sum():
    rng = random.Random(1)
    for _ in range(200):
        available = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
        first, capacity = rng.randint(1, 60), 64
        sums = {first}
        for length, n in available.items():
            sums |= {s + k * length for s in sums for k in range(n + 1)}
        chosen = packing.fill(first, dict(available), capacity)
        assert sum(chosen) == max(s for s in sums if s <= capacity)
        assert not Counter(chosen[1:]) - Counter(available)


def test_chunks_have_the_ids_of_texts():
    tokenizer, ids_of = Tokenizer.from_file(TOKENIZER), packing.WordIds(Tokenizer.from_file(TOKENIZER), most=40)
    for text in ("It's <|endoftext|> we'll SEE... ab12,. ΣΑΣ ὈΔΥΣΣΕΎΣ İstanbul naïve'd", "é  x y\u0085z", "a,b. c,, d.'s end.", "word " * 300 + "other, WORDS."):
        assert np.frombuffer(ids_of.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_chunks_keep_control_characters():
    tokenizer, ids_of = Tokenizer.from_file(TOKENIZER), packing.WordIds(Tokenizer.from_file(TOKENIZER))
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    for text in ["a\x1cb", "\x1d", "It's \x1e x\x1f, É\x1c", "日\x1f本 \x1c\x1c", "x".join(spaces)]:
        assert np.frombuffer(ids_of.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_random_texts_are_the_tokenizer_s():
    tokenizer, ids_of, rng = Tokenizer.from_file(TOKENIZER), packing.WordIds(Tokenizer.from_file(TOKENIZER), most=5000), random.Random(11)
    pool = list("abzAZ09,.'!-_ßÿÀÉéµªº×÷İıΣςσǅŉﬁЖжйЙ日本한กَ่") + ["\u0301", "\u0307", "\u0338", "\u030a", "A\u030a", "=", " ", " ", "\t", "\n", "\r\n", "'s", "'LL", "'re", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>"]
    pool += [chr(c) for c in (*range(0x1C, 0x20), 0, 0x7F, 0x85, 0xA0, 0xAD, 0x180E, 0x1680, 0x2000, 0x2001, 0x200B, 0x2028, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF, 0x1F600, 0xE0100, 0x1D7D8, 0x10FFFF, 0xFFFD)]
    texts = ["".join(rng.choices(pool, k=rng.randint(1, 12))) for _ in range(60_000)]
    texts += ["".join(chr(rng.choice((rng.randrange(0x20, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x30000)))) for _ in range(rng.randint(1, 12))) for _ in range(60_000)]
    wrong = [t for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)) if np.frombuffer(ids_of.encode(t), "<u4").tolist() != e.ids]
    assert not wrong


def test_very_many_short_pieces_are_packed_by_slack():
    packer, windows = packing.Packer(64, 8), []
    for key in range(5000):
        windows += packer.add(key, np.ones(1 + key % 2, dtype="<u4"))
        assert packer.held <= 2 * 64
    windows += packer.rest()
    sizes = [sum(len(p[2]) for p in w) for w in windows]
    assert sum(sizes) == 7500 and set(sizes[:-10]) == {64}


# 6. HTML


def test_main_text_leaves_furniture_out():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav>
    <div class="cookie-notice">We use cookies</div><div id="main"><h1>Head &amp; line</h1><p>First   paragraph of the article, long enough to be one.<p>Short.
    <p>Another <b>long</b> paragraph of text&nbsp;here, with <a href=x>a link</a> in it.<script>var x = "<p>no</p>";</script></div>
    <aside>Side</aside><form><label>Name</label></form><div class="comments"><p>A reader's comment that is rather long, longer than most.</p></div><footer>&copy; Foot</footer>"""
    assert html_text.main_text(page) == "Head & line\nFirst paragraph of the article, long enough to be one.\nShort.\nAnother long paragraph of text here, with a link in it."


def test_main_text_of_articles_and_broken_pages():
    assert html_text.main_text("<body><div class=ad>Buy this now</div><article><h1>A</h1><p><b>B<br><p>C</article><footer>D") == "A\nB\nC"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<html><body></body>") == ""
    assert "text" in html_text.main_text("<p>text <![foo bar <p>more") and html_text.main_text("just text") == "just text"


def test_unreadable_declarations_are_text_once():
    assert html_text.main_text("<article><p>text <![foo bar <p>more</article>") == "text <![foo bar\nmore"
    words = "word " * 200
    assert html_text.main_text(f"<p>{words}<![ x</p>") == words + "<![ x"


def test_names_do_not_drop_what_holds_the_article():
    story = "<h1>Head</h1><p>A paragraph of the article, long enough to be one.<p>Another paragraph of it, of about that length."
    text = "Head\nA paragraph of the article, long enough to be one.\nAnother paragraph of it, of about that length."
    extra = '<div class="ad-box">Buy this</div><div class=comments><p>Nice.</div>'
    for start, end in (
        ('<div class="content-sidebar-wrap">', "</div>"), ('<div id="page" class="has-sidebar">', "</div>"), ('<div class="no-sidebar">', "</div>"), ("<form action=x>", "</form>"), ('<div class="sidebar-left">', "</div>"),
        ('<article class="post tag-social">', "</article>"), ('<article class="category-notice tag-search">', "</article>"), ('<form><div class="widget"><main class="search">', "</main></div></form>"),
    ):
        assert html_text.main_text(f"<body>{start}{story}{extra}{end}</body>") == text, start


def test_extract(spark):
    df = spark.createDataFrame([(1, None, None, 1), (2, "u", "<p>x</p>", 2), (2, "u", "<p>x</p>", 2)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()) == [(1, "", 0), (2, "x", 1), (2, "x", 1)]
    assert html_text.extract(df.limit(0)).count() == 0


# 7. Quality rules


def test_quality_against_plain(spark, docs):
    rows = docs.collect()
    blank = lambda x: not plain_words(x)
    normal = lambda x: " ".join(plain_words(re.sub("[0-9]+", "0", re.sub("[A-Z]", lambda m: m[0].lower(), x))))
    lines = [[x for x in (r.text or "").split("\n") if not blank(x)] for r in rows]
    holders, ids = defaultdict(set), defaultdict(set)
    for r, own in zip(rows, lines):
        ids[r.source].add(r.doc_id)
        for x in own:
            holders[r.source, normal(x)].add(r.doc_id)
    count, hosts = ({k: len(v - {None}) for k, v in x.items()} for x in (holders, ids))
    expected = []
    for r, own in zip(rows, lines):
        words = plain_words(r.text)
        wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {j for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
        gone = sum(len(plain_words(x)) for x in own if count[r.source, normal(x)] > max(2, 0.01 * hosts[r.source]))
        left = len(words) - gone
        expected.append((str(r.doc_id), len(words), sum(map(len, words)), sum((r.text or "").count(c) for c in "#*$%&|<>"), len(own) - len(set(own)), len(inside), failed, gone, not failed and left >= 10 and left >= 0.3 * len(words)))
    found = sorted((str(r.doc_id), *r[1:]) for r in quality.assess(docs, min_documents=2).collect())
    assert found == sorted(expected)


def test_quality_of_repeated_rows_against_sql(spark, tmp_path, monkeypatch):
    import duckdb

    line = "a line that very many of this host's documents hold, in these same words every time"
    words = " ".join(f"own{k}" for k in range(8))
    rows = [(7, f"{line}\n{words} once", "a")] * 30 + [(k, f"{line}\n{words} {k}", "b") for k in range(30)] + [(None, f"{line}\n{words}", "c")] * 30 + [(k % 5, f"{line}\n{words} {k}", None) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = sorted(map(str, con.execute(quality.OP7_SQL).fetchall()))
    for hot in (1000, 20):
        monkeypatch.setattr(quality, "HOT_ROWS", hot)
        found = quality.op7(spark, str(tmp_path)).collect()
        assert sorted(str(tuple(r)) for r in found) == expected
    assert len(found) == 130 and sum(r.kept for r in found) == 100  # all but those of host b


def test_quality_has_no_python(spark):
    plan = "".join(f(documents(spark))._jdf.queryExecution().toString() for f in (quality.text_figures, quality.assess))
    assert not re.search("Python|Pandas|Arrow", plan)


# 8. Toxicity


def toy_labels(spark):
    rows = [(k, f"some plain words number {chr(97 + k % 20)}{chr(97 + k % 7)} and " + (["you Vermin fool", "v3rmin indeed", "what vеrmin"][k % 3] + " vermin" if k % 4 == 0 else "a vermin trap is clean" if k % 4 == 1 else "nothing else")) for k in range(400)]
    docs = spark.createDataFrame([(*r, 1) for r in rows] + [(None, None, 1), (1001, "", 1), (0, rows[0][1], 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity_learns_stems_and_exceptions(spark):
    docs, labels = toy_labels(spark)
    lexicon = toxicity.learn(docs, labels)
    found = {(r.doc_id, r.predicted) for r in toxicity.score(docs, lexicon).collect()}
    assert all((k, int(k % 4 == 0)) in found for k in range(400) if k % 4 != 1)
    assert {(None, 0), (1001, 0)} <= found
    assert toxicity.Lexicon({"verm": 5.0}, frozenset({("vermin", "trap")}), (-3.0, 2.0, 1.0)).total("a vermin trap") == (0, 3)


def test_toxicity_folds():
    assert toxicity.fold("1D1OT ѕсum ｆool l0$er p@th $5") == "idiot scum fool loser path $5"
    assert toxicity.fold("4553 in 1984, 50 v3rmin4 x_5") == "4553 in 1984, 50 vermina x_5"
    start = time.time()
    for text in ("1" * 500_000, "a" * 500_000, "a1" * 250_000, "_" * 500_000):
        assert len(toxicity.fold(text)) == 500_000
    assert time.time() - start < 10


def plain_entries(text):
    words = re.findall(r"[^\W\d_]+", toxicity.fold(text))
    return {w[:k] for w in words for k in range(4, min(8, len(w)) + 1)} | {w + " " for w in words if len(w) < 4}


def plain_hits(text, weights):
    """(word before, word, word after, weight) by comparing every word with every entry."""
    words = ["", *re.findall(r"[^\W\d_]+", toxicity.fold(text)), ""]
    for k in range(1, len(words) - 1):
        own = [w for e, w in weights.items() if (words[k] + " ").startswith(e)]
        if own:
            yield words[k - 1], words[k], words[k + 1], max(own)


def plain_lexicon(rows):
    """rows: (text, toxic)."""
    n = Counter(t for _, t in rows)
    counts = [Counter(e for text, t in rows if t == side for e in plain_entries(text)) for side in (0, 1)]
    least = max(toxicity.LEAST_DOCUMENTS, math.ceil(toxicity.LEAST_SHARE * n[1]))
    odds = {e: math.log((c + 0.5) / (n[1] + 1)) - math.log((counts[0][e] + 0.5) / (n[0] + 1)) for e, c in counts[1].items() if c >= least}
    weights = {}
    for e in sorted(odds, key=lambda e: (-odds[e], len(e), e)):
        if odds[e] >= toxicity.LEAST_LOG_ODDS and not any(c.startswith(e) or e.startswith(c) for c in weights):
            weights[e] = odds[e]
    pairs = [Counter(), Counter()]
    for text, t in rows:
        pairs[t].update({p for a, w, b, _ in plain_hits(text, weights) for p in ((a, w), (w, b)) if all(p)})
    exceptions = {p for p, c in pairs[0].items() if c >= toxicity.EXCEPTION_DOCUMENTS and not pairs[1][p]}
    total = lambda text: sum(x for a, w, b, x in plain_hits(text, weights) if (a, w) not in exceptions and (w, b) not in exceptions)
    measure = lambda text: (total(text), len(toxicity.fold(text).split()))
    b0, b1, b2 = toxicity.fit(sorted((t, *measure(text)) for text, t in rows))

    def score(text):
        found, words = measure(text)
        return 1 / (1 + math.exp(-(b0 + b1 * math.log1p(found) + b2 * math.log1p(100 * found / max(words, 10)))))

    return weights, exceptions, score


@pytest.mark.parametrize("source", ["toy", "documents"])
def test_toxicity_against_plain(spark, source):
    docs, labels = toy_labels(spark) if source == "toy" else (documents(spark), spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = defaultdict(int)
    for r in labels.collect():
        if r.doc_id is not None and r.toxic is not None and not held(r.doc_id):
            toxic[r.doc_id] = max(toxic[r.doc_id], int(r.toxic != 0))
    texts = {r.doc_id: r.text for r in docs.collect()}
    weights, exceptions, score = plain_lexicon([(texts[d], t) for d, t in toxic.items() if d in texts])
    lexicon = toxicity.learn(docs, labels)
    assert lexicon.weights == pytest.approx(weights) and lexicon.exceptions == exceptions
    found = toxicity.score(docs, lexicon).collect()
    texts_of = defaultdict(list)
    for r in docs.collect():
        texts_of[r.doc_id].append(r.text)
    for r in found:
        assert any(r.score == pytest.approx(score(text), abs=1e-9) for text in texts_of[r.doc_id]) and r.predicted == int(r.score >= 0.7) and r.held_out == held(r.doc_id)


def test_toxicity_held_out_ranking(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    bad, good = [r.score for r in found if r.toxic], [r.score for r in found if not r.toxic]
    assert bad and sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good)) >= 0.85  # some labels are noise


def test_short_words_and_far_neighbours():
    short = toxicity.Lexicon({"vil ": 4.0, "verm": 5.0}, frozenset({("a" * 100, "vermin")}), (-3.0, 2.0, 1.0))
    assert short.total("evil vile vil")[0] == 4 and short.total("VIL!")[0] == 4
    assert short.total("a" * 100 + " " * 200 + "vermin")[0] == 0 and short.total("b vermin")[0] == 5


def test_toxicity_without_labels(spark):
    docs, labels = toy_labels(spark)
    assert {(r.score, r.predicted) for r in toxicity.score(docs, toxicity.learn(docs, labels.limit(0))).collect()} == {(0.0, 0)}
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), labels)).count() == 0


# 9. SimHash


def plain_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def test_simhash_against_plain(spark, docs):
    rows = docs.collect()
    fps = defaultdict(list)
    for r in rows:
        if r.doc_id is not None:
            fps[plain_fingerprint(r.text)].append(r.doc_id)
    keys = list(fps)
    pairs = [(fps[a][0], fps[b][0]) for i, a in enumerate(keys) for b in keys[:i] if (a ^ b).bit_count() <= 3] + [(v[0], x) for v in fps.values() for x in v]
    of = plain_components({x for v in fps.values() for x in v}, pairs)
    expected = sorted((str(r.doc_id), plain_fingerprint(r.text), of.get(r.doc_id)) for r in rows)
    assert sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()) == expected
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {x for x, c in of.items() if x == c} | {r.doc_id for r in rows if r.doc_id is None}


def plain_shingles(text, shingle=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def test_near_copies_beyond_three_bits(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        rows.append((3 * k, " ".join(words)))
        for copy, edits in ((1, len(words) // 60), (2, len(words) // 25)):
            other = list(words)
            for at in rng.sample(range(len(words)), edits):
                other[at] = "changed"
            rows.append((3 * k + copy, " ".join(other)))
    rows += [(500, "one two"), (501, "One  two"), (502, "one two three"), (503, None), (504, " "), (None, "one two")]
    sets = {d: plain_shingles(t) for d, t in rows if d is not None}
    near = [(a, b) for a in sets for b in sets if b < a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert any((plain_fingerprint(dict(rows)[a]) ^ plain_fingerprint(dict(rows)[b])).bit_count() > 3 for a, b in near)
    of = plain_components(sets, near)
    kept = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [x for x, c in of.items() if x == c] + [None]))


def test_near_copies_of_chains_in_tiny_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 600)
    rng = random.Random(8)
    rows = []
    for chain in range(6):  # a text changes word by word, so that only those close in the chain are similar
        words = [f"w{rng.randrange(3000)}" for _ in range(120)]
        for _ in range(50):
            rows.append((len(rows), " ".join(words)))
            for at in rng.sample(range(120), 2):
                words[at] = f"w{rng.randrange(3000)}"
    rows += [(len(rows) + k, rows[k][1]) for k in range(0, 300, 7)]
    sets = {d: plain_shingles(t) for d, t in rows}
    near = [(a, b) for a in sets for b in sets if b < a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    of = plain_components(sets, near)
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "xxhash64(text) as _row")).collect()
    groups, plain = defaultdict(set), defaultdict(set)
    for r in found:
        groups[r.component_id].add(r.doc_id)
    for d, c in of.items():
        plain[c].add(d)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


@given(st.lists(st.sets(st.integers(0, 3000), min_size=1, max_size=12), min_size=1, max_size=8), st.lists(st.sets(st.integers(0, 3000), min_size=1, max_size=12), min_size=1, max_size=8))
def test_similarity_of_sets(left, right):
    sides = [[np.sort(np.array(list(x), dtype=np.uint64)) for x in side] for side in (left, right)]
    assert near_copies.similar(*sides).tolist() == [[5 * len(a & b) >= 4 * len(a | b) for b in right] for a in left]


def test_near_copies_meet_by_simhash():
    rng = random.Random(11)
    found = np.array(sorted(rng.getrandbits(64) for _ in range(700)), dtype=np.uint64)
    hashes = near_copies.mixed(found[:, None] ^ near_copies.FLIPS)
    plain = [2 * sum(int(h) >> b & 1 for h in hashes[:, w]) > len(found) for w in range(hashes.shape[1]) for b in range(64)]
    bits = near_copies.fingerprint(found)
    assert bits.tolist() == plain
    keys = near_copies.table_keys(bits).tolist()
    assert keys == [(t << 12) + sum(plain[12 * t + k] << k for k in range(12)) for t in range(64)]
    for n, more in ((700, 0), (80, 20), (8, 2), (9, 0)):  # sets just similar enough
        for _ in range(40):
            both = [rng.getrandbits(64) for _ in range(n - (n // 9 if not more else 0))]
            left, right = ([*both, *[rng.getrandbits(64) for _ in range(k)]] for k in ((0, more) if more else (n // 9, n // 9)))
            a, b = (near_copies.fingerprint(np.array(x, dtype=np.uint64)) for x in (left, right))
            assert (near_copies.table_keys(a) == near_copies.table_keys(b)).any() and (a[:384] != b[:384]).sum() <= near_copies.RADIUS


@pytest.mark.parametrize("many", [4096, 30])
def test_clusters_of_buckets(monkeypatch, many):
    import pyarrow as pa

    monkeypatch.setattr(near_copies, "MANY", many)
    monkeypatch.setattr(near_copies, "CELLS", 50)
    rng = random.Random(12)
    centres = [[rng.getrandbits(64) for _ in range(6)] for _ in range(40)]
    rows = []
    for node in range(400):
        c = rng.randrange(40 if node % 2 else 2)
        rows.append((c % 3, 256 + rng.randint(60, 110), node - 200, *[x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in centres[c]]))
    rows.sort()
    near = [(a[2], b[2]) for a in rows for b in rows if a < b and a[0] == b[0] and sum((x ^ y).bit_count() for x, y in zip(a[3:], b[3:])) <= near_copies.RADIUS and 5 * (a[1] - 256) >= 4 * (b[1] - 256)]
    of = plain_components([r[2] for r in rows], near)
    n = Counter(of.values())
    for size in (7, 1000):
        parts = [pa.RecordBatch.from_arrays([pa.array(np.array(c, dtype=np.uint64).view(np.int64) if k > 2 else np.array(c, dtype=np.int32 if not k else np.int64)) for k, c in enumerate(zip(*rows[i : i + size]))], names=list("abcdefghi")) for i in range(0, 400, size)]
        found = [tuple(r.values()) for x in near_copies.cluster_batches(iter(parts)) for r in x.to_pylist()]
        assert sorted(found) == sorted((c, node, n[c]) for node, c in of.items() if n[c] > 1)


def test_links_of_a_group_grow_with_its_members(spark, monkeypatch):
    rng = random.Random(13)
    words = [f"w{k}" for k in range(150)]
    given = []
    monkeypatch.setattr(near_copies, "components", lambda edges: given.append(edges.distinct().count()) or components(edges))
    for n in (75, 300):
        rows = [(k, " ".join("changed" if at in some else w for at, w in enumerate(words))) for k in range(n) for some in [rng.sample(range(150), 2)]]
        sets = {d: plain_shingles(t) for d, t in rows}
        near = [(a, b) for a in sets for b in sets if b < a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
        of = plain_components(sets, near)
        kept = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r.doc_id for r in kept.collect()) == sorted(x for x, c in of.items() if x == c) and len(set(of.values())) < n // 10
        assert given[0] <= 3 * n, given
        given.clear()


@given(st.lists(st.lists(st.integers(-9, 40), min_size=1, max_size=9, unique=True), max_size=12))
@settings(max_examples=8, deadline=None)
def test_links_of_leasts_connect_what_clusters_connect(spark, clusters):
    found = [(min(c), x, len(c)) for c in clusters for x in c]
    edges = [tuple(r) for r in near_copies.star_links(spark.createDataFrame(found, "least long, node long, n long")).collect()]
    nodes = {x for _, x, _ in found}
    assert plain_components(nodes, edges) == plain_components(nodes, [r[:2] for r in found]) and len(edges) == len(set(edges))


def test_near_copies_are_decided_by_row(spark):
    words = [f"w{k}" for k in range(100)]
    copy, other = " ".join([*words[:-1], "end"]), "a clean text of its own under the id that a copy has as well"
    rows = [(1, " ".join(words), "a"), (2, copy, "a"), (2, other, "a"), (3, "twice the same", "b"), (3, "twice the same", "b"), (None, "twice the same", "b"), (None, "twice the same", "b")]
    kept = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [rows[0], rows[2], rows[3], rows[5], rows[6]]))


def test_masks_cover():
    masks = [m % (1 << 64) for m in simhash.covering_masks(3)]
    rng = random.Random(2)
    for _ in range(2000):
        x = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not x & m for m in masks)
    assert len(masks) == 15 and min(m.bit_count() for m in masks) >= 30


def test_large_buckets_lose_no_link(spark, monkeypatch):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(400)})
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp long, node long")
    expected = plain_components(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    for at_once in (1024, 16):
        arr = np.array(fps, np.uint64)
        links = {(min(a, b), max(a, b)) for i, j in simhash.linked(arr, 3, at_once=at_once) for a, b in zip(i.tolist(), j.tolist())}
        assert links == {(j, i) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3}
    found = {r.id: r.component for r in components(simhash.fingerprint_links(nodes)).collect()}
    assert {k: found.get(k, k) for k in range(len(fps))} == expected


def test_batches_cut_buckets(spark):
    rows = sorted((t, k // 5, (k % 5) | t << 20, k + 100 * t) for t in range(3) for k in range(50))
    whole = [tuple(c) for c in zip(*rows)]

    def run(size):
        import pyarrow as pa

        names, kinds = ["t", "k", "fp", "node"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        parts = [pa.RecordBatch.from_arrays([pa.array(list(c[i : i + size]), k) for c, k in zip(whole, kinds)], names=names) for i in range(0, len(rows), size)]
        edges = [(a, b) for x in simhash.link_batches(3)(iter(parts)) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())]
        return plain_components({r[3] for r in rows}, edges)

    assert run(1) == run(3) == run(7) == run(1000)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 40)] + [(100 + k, 200 - k) for k in range(50)]])
def test_components(spark, edges):
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    nodes = {x for e in edges for x in e}
    assert {n: found.get(n, n) for n in nodes} == plain_components(nodes, edges)


# 10. Embeddings


def vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + rng.normal(size=16) * 0.25).astype(np.float32).tolist(), 0) for k in range(300)]
    rows += [(300, rows[5][1], 0), (301, rows[5][1], 0), (301, rows[5][1], 0), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] * 16, 0), (305, [None] + [1.0] * 15, 0), (306, [], 0), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0), (None, rows[5][1], 0), (309, [float("inf")] + [1.0] * 15, 0), (310, [x * 3 for x in rows[9][1]], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")


def plain_vectors(rows):
    sound = [r.vec_id is not None and r.embedding is not None and len(r.embedding) > 0 and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding) for r in rows]
    x = [np.array(r.embedding, float) if s else None for r, s in zip(rows, sound)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sound[i] and sound[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] / (np.sqrt(x[i] @ x[i]) * np.sqrt(x[j] @ x[j])) >= 0.9]
    links = Counter(k for p in pairs for k in p)
    of = plain_components({r.vec_id for r in rows if r.vec_id is not None}, [(rows[i].vec_id, rows[j].vec_id) for i, j in pairs])
    return sorted(((str(r.vec_id), links[k], of.get(r.vec_id), of.get(r.vec_id) == r.vec_id and r.vec_id is not None) for k, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("tile,block", [(8192, 1024), (40, 16)])
def test_embeddings_against_plain(spark, monkeypatch, tile, block):
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    found = sorted(((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(vectors(spark)).collect()), key=str)
    assert found == plain_vectors(vectors(spark).collect())


def test_embeddings_of_no_rows(spark):
    assert embeddings.near_duplicates(vectors(spark).limit(0)).count() == 0
    assert embeddings.near_duplicates(vectors(spark).filter("vec_id = 302")).collect()[0].asDict() == {"vec_id": 302, "n_links": 0, "component_id": 302, "kept": True}


# The pipeline


def test_pipeline_stages(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name


def test_pipeline_against_plain(spark, tmp_path):
    documents(spark).limit(120).write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet")).collect()
    rows = [r for r in rows if any(c.isalpha() for c in r.text or "")]
    sets = {r.doc_id: plain_shingles(r.text) for r in rows}
    of = plain_components(sets, [(a, b) for a in sets for b in sets if b < a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    rows = [r for r in rows if of[r.doc_id] == r.doc_id]
    seen, texts = {}, {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        b = r.text.encode()
        for p in range(len(b) - 49):
            seen.setdefault(b[p : p + 50], r.doc_id)
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < r.doc_id:
                gone[p : p + 50] = b"\1" * 50
        text = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if not any(gone) or plain_words(text):
            texts[r.doc_id] = (r.source, text)
    sizes = Counter()
    for source, text in texts.values():
        sizes[source] += len(plain_words(text))
    target = plain_targets(sizes)
    tokenizer, expected, taken, at = Tokenizer.from_file(TOKENIZER), Counter(), Counter(), 0
    mixed = [Document(d, source, text) for d, (source, text) in texts.items()]
    for _, place, end, words, key in plain_queue(mixed, target):
        text = texts[int(key)][1]
        size = sizes[texts[int(key)][0]]
        taken[int(key), (end - words) // size] += max(0, min(words, sum(sizes.values()) - at))
        at += words
    for (d, _), take in (+taken).items():
        text = texts[d][1]
        cut = text if take == len(plain_words(text)) else re.match(r"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){%d}" % take, text)[0]
        expected[d] += len(tokenizer.encode(cut, add_special_tokens=False).ids) + 1
    found = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        found[r.doc_id] += r.length
    assert found == expected


# 3. WARC fixity


def archive(spark):
    rows = [(k, f"https://h{k % 7}.example/{k}", f"<p>{'x' * (k % 50)}é {k}</p>", 0) for k in (*range(-5, 2400, 3), (1 << 62) + 5, -(1 << 62), (1 << 63) - 1, -(1 << 63), (1 << 53) + 1)] + [(None, None, None, 1), (None, "u", "v", 1), (9, "https://same", "a", 1), (9, "https://same", "a", 1), (9, "https://same", "b", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, slot int")


def plain_audit(own, theirs):
    key = lambda r: (r.page_id, r.url or "")
    a, b, out = defaultdict(list), defaultdict(list), Counter()
    for side, rows in ((a, own), (b, theirs)):
        for r in rows:
            side[key(r)].append(hashlib.sha256((r.html or "").encode()).hexdigest())
    for k in set(a) | set(b):
        x, y = sorted(a[k]), sorted(b[k])
        out[k, "missing"] += max(0, len(x) - len(y))
        out[k, "extra"] += max(0, len(y) - len(x))
    return +out


def test_audit_finds_all_damage(spark):
    own = archive(spark)
    hit = F.coalesce("page_id", F.lit(-1)) % 100 == 16
    theirs = own.filter("page_id is null or page_id % 101 <> 3").withColumn("html", F.when(hit, F.concat("html", F.lit("!"))).otherwise(F.col("html"))).unionByName(own.filter("page_id = 1").withColumn("url", F.lit("new")))
    found = warc_fixity.audit(own, theirs).collect()
    count = Counter(((r.page_id, r.url), r.state) for r in found if r.state != "changed")
    assert count == plain_audit(own.collect(), theirs.collect())
    assert {r.page_id for r in found if r.state == "changed"} == {r.page_id for r in own.filter(hit).collect()} - {r.page_id for r in found if r.state == "missing"}
    assert all((r.record_offset is None) == (r.state == "extra") for r in found)


def test_inventory_against_plain(spark):
    """Many copies and one large file, over several partitions."""
    rows = [(k % 40, f"u{k % 3}", "x" * (k % 11)) for k in range(400)] + [(None, "same", "y")] * 500 + [(-7 * k, "u", "z") for k in range(1, 300)]
    own = spark.createDataFrame(random.Random(4).sample(rows, len(rows)), "page_id long, url string, html string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = sorted(warc_fixity.inventory(warc_fixity.records(own)).collect(), key=lambda r: r.slot)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.slot for r in found] == list(range(len(rows)))
    key = lambda r: (r.file_no, r.page_id is not None, r.page_id or 0, r.url, r.digest)
    assert [key(r) for r in found] == sorted(key(r) for r in found)
    offsets, copies = Counter(), Counter()
    for r in found:
        copies[r.page_id, r.url] += 1
        assert r.file_no == (0 if r.page_id is None else r.page_id // 1000 + 1) and r.record_offset == offsets[r.file_no] and r.copy == copies[r.page_id, r.url]
        offsets[r.file_no] += r.length


def test_audit_of_equal_and_empty_archives(spark):
    own = archive(spark)
    assert warc_fixity.audit(own, own.repartition(3)).count() == 0
    assert warc_fixity.audit(own.limit(0), own.limit(0)).count() == 0
    assert {r.state for r in warc_fixity.audit(own.limit(0), own.limit(3)).collect()} == {"extra"} and {r.state for r in warc_fixity.audit(own.limit(3), own.limit(0)).collect()} == {"missing"}


def test_audit_compares_only_below_what_differs(spark):
    places = warc_fixity.inventory(warc_fixity.records(archive(spark)))
    leaf, levels = places.select("slot", "digest"), warc_fixity.height(places)
    one = places.filter("page_id = 1003").first().slot
    left, right = warc_fixity.tree(leaf, levels), warc_fixity.tree(leaf.withColumn("digest", F.when(F.col("slot") == one, "x").otherwise(F.col("digest"))), levels)
    changed = left.join(right.withColumnRenamed("digest", "d"), ["level", "node"]).filter("digest <> d").groupBy("level").count().collect()
    assert all(r["count"] == 1 for r in changed) and len(changed) == levels + 1
    assert [r.slot for r in warc_fixity.descend(left, right, levels).collect()] == [one]


def test_warc_files_round_trip(spark, tmp_path):
    import gzip

    pages = archive(spark).filter("page_id is not null").limit(20)
    body = [r[0].encode() for r in pages.select(warc_fixity.record_bytes(F.col("page_id"), F.col("url"), F.col("html"))).collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(body))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, body)))
    (tmp_path / "c.warc").write_bytes(b"".join(body)[:-10])
    found = warc_fixity.read_warc(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    by = defaultdict(list)
    for r in found:
        by[r.path.rsplit("/", 1)[1]].append(r)
    html = sorted(r.html.encode() for r in pages.collect())
    assert sorted(bytes(r.payload) for r in by["a.warc"]) == sorted(bytes(r.payload) for r in by["b.warc.gz"]) == html and len(by["c.warc"]) == 19
    assert [(r.offset, r.length) for r in by["a.warc"]] == [(sum(map(len, body[:k])), len(b)) for k, b in enumerate(body)]
