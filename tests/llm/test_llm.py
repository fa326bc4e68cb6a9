import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from loomveil.llm import chat, decontam, lm_score, ngram_join, packing, quality, sentences, substring_dedup, textops, token_counts, warc
from loomveil.llm.shared import new_path

DOCS = "doc_id bigint, text string, source string, lang string, id bigint"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "s", "en", -1) for i, t in enumerate(texts)], DOCS)


def brute_repeats(words):
    n, out = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_quality_against_brute_force():
    rnd = random.Random(1)
    texts = [None, "", " \n", "a", "a a a"] + ["\n".join(" ".join(rnd.choice("ab#é") for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(0, 7))) for _ in range(60)]
    found = quality.figures(pa.array(texts))
    for i, t in enumerate(texts):
        w = WORDS.findall(t or "")
        most = brute_repeats(w)
        cover = lambda m: len({p for k, n in enumerate(most) if n >= m for p in range(k, k + (n if m > 3 else 3))})
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        assert [int(found[k][i]) for k in quality.FIGURES] == [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), cover(3), cover(10), max(most, default=0)]


def test_quality_keeps_columns_and_repeated_rows(spark):
    clean = " ".join(f"w{i}" for i in range(80))
    df = docs(spark, [clean, clean, None, "x " * 80])
    assert sorted(r.doc_id for r in quality.keep_good(df).collect()) == [0, 1]
    assert quality.keep_good(df).columns == df.columns
    assert quality.quality_report(df.limit(0)).count() == 0


def test_sentencepiece_equals_the_library():
    table, rnd = sentences.ChunkTable(sentences.default_model()), random.Random(3)
    parts = ["a", " ", "  ", "\n", "▁", "é", "日", "\x00", "\t", "😀", " the", "<s>", "<unk>", "<0x41>"]
    texts = [None, "", " ", "▁", "b" * 30_000] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    for t, (n, joined, back) in zip(texts, table.encode(texts)):
        ids = table.library.encode(t or "")
        assert (n, joined, back) == (len(ids), ",".join(map(str, ids)).encode(), table.library.decode(ids))


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORDS.findall(lower(t))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in sets:
        for y in sets:
            a, b = sets[x], sets[y]
            if x < y and a and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(x), find(y)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_join_against_brute_force(spark):
    rnd = random.Random(2)
    base = [[f"{rnd.choice('abcdefgh')}{rnd.randint(0, 30)}" for _ in range(rnd.choice([1, 2, 3, 12, 40, 80]))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            if len(w) > 5:
                w[rnd.randrange(len(w))] = f"z{rnd.randint(0, 3)}"
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "A1 B"), (1004, "a1 b")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows] + [(None, "a b c", 0)], "doc_id bigint, text string, item bigint")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(df).collect()}
    assert got.pop(None) == (1, None)
    assert got == brute_components(rows, 3, 90)


def test_ngram_join_by_pairs_of_neighbours_against_brute_force(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))) for i in range(120)]
    base = [f"v{i}" for i in range(60)]
    for i in range(200, 260):
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"y{rnd.randint(0, 9)}"
        rows.append((i, " ".join(w[rnd.randint(0, 3) :])))
    df = spark.createDataFrame([(i, t, "s", "en", -1) for i, t in rows], DOCS)
    for n, percent in [(2, 80), (1, 85), (2, 60)]:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(df, n=n, percent=percent).collect()}
        assert got == brute_components(rows, n, percent)


def test_ngram_join_sets_that_share_one_rare_shingle_do_not_meet(spark):
    rows = [(i, " ".join([*(f"a{i}x{k}" for k in range(20)), "one", "two", "three", *(f"b{i}x{k}" for k in range(20))])) for i in range(30)]
    found = ngram_join.set_table(spark.createDataFrame(rows, "id bigint, text string"), 3, 80).collect()
    assert max(Counter(b for r in found for b in r.prefix).values()) == 1 and all(len(r.prefix) == 2 * 20 * r.n_shingles // 100 + 1 for r in found)
    members = ngram_join.bucket_members(spark.createDataFrame([(7, 5, [3, 4]), (8, 5, None), (9, 5, [6])], "item bigint, n_shingles bigint, prefix array<bigint>"))
    assert {(r.item, r.at, r.bucket, r.before) for r in members.collect()} == {(7, 0, 3, None), (7, 1, 4, 3), (9, 0, 6, None)}


def test_ngram_join_writes_members_of_repeated_buckets_alone(spark):
    rnd = random.Random(12)
    rows = [(i, 50, [rnd.getrandbits(63) for _ in range(20)] + [rnd.randint(0, 900), 7], i) for i in range(300)]
    heads = spark.createDataFrame(rows, "item bigint, n_shingles bigint, prefix array<bigint>, key1 bigint")
    repeats = ngram_join.Repeats.of(heads, 300 * 22)
    times = Counter(b for r in rows for b in r[2])
    passing = [b for b, ok in zip(times, repeats(np.array(list(times), np.int64))) if ok]
    assert {b for b, n in times.items() if n > 1} <= set(passing) and len(passing) < len(times) / 10
    members = ngram_join.bucket_members(heads, repeats=spark.sparkContext.broadcast(repeats))
    assert sorted((r.item, r.at, r.bucket) for r in members.collect()) == sorted((i, at, b) for i, _, p, _ in rows for at, b in enumerate(p) if b in set(passing))
    assert "Exchange" not in members._jdf.queryExecution().toString()
    assert not ngram_join.Repeats.of(heads.where("false"), 0)(np.array([1], np.int64)).any()


def test_pipeline_drops_a_near_copy_with_one_edit(spark):
    words = [f"w{i}" for i in range(50)]
    df = docs(spark, [" ".join(words), " ".join([*words[:25], "x", *words[26:]]), " ".join(words[:25])])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()) == [0, 2]


def test_substring_dedup_cuts_later_copies(spark):
    passage = " ".join(f"p{i}" for i in range(60)) + "."
    near = passage.replace("p30 ", "q30 ")
    own = [" ".join(f"d{k}w{i}" for i in range(40)) + "." for k in range(5)]
    df = docs(spark, [f"{own[0]}\n{passage}", f"{own[1]} {passage}", f"{own[2]}\n{near}\nend", own[3], None, "", own[4]])
    out = {r.doc_id: r for r in substring_dedup.dedup_substrings(df, report=True).collect()}
    assert out[0].text == f"{own[0]}\n{passage}" and out[0].n_removed_words == 0
    assert "p5 p6" not in out[1].text and own[1].rstrip(".") in out[1].text and out[1].source_ids == [0]
    assert "p5 p6" not in out[2].text and out[2].text == f"{own[2]}\nend"
    assert [out[k].text for k in (3, 4, 5, 6)] == [own[3], None, "", own[4]]


def test_substring_dedup_finds_passages_wherever_they_start(spark):
    words = [f"p{i}" for i in range(60)]
    own = [[f"d{k}w{i}" for i in range(40)] for k in range(8)]
    wrap = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    near = [*words[:30], "q", *words[31:]]
    texts = [
        " ".join([*own[0], *words, *own[0]]),
        " ".join([*own[1], *words[3:55], *own[1][::-1]]),  # in mid-sentence, 52 words
        wrap([*own[2], *words, "tail"], 7),  # wrapped at other places
        wrap(near, 8),  # a near copy of the next, in short lines
        " ".join(near[:50] + ["r"] + near[51:]),
        " ".join([*own[5], *words[:44], *own[5]]),  # too short
        " ".join([*own[6], *own[5][-9:], *words[44:], *own[5][:9]]),  # short pieces
    ]
    df = docs(spark, texts)
    out = {r.doc_id: r for r in substring_dedup.dedup_substrings(df, report=True).collect()}
    assert [out[k].text for k in (0, 5, 6)] == [texts[k] for k in (0, 5, 6)]
    assert out[1].text.split() == [*own[1], *own[1][::-1]] and out[1].n_removed_words == 52 and out[1].source_ids == [0]
    assert out[2].text.split() == [*own[2], "tail"] and out[2].n_removed_words == 60
    assert out[3].text == texts[3] and out[4].text == ""


def test_verbatim_spans_against_brute_force(spark):
    rnd = random.Random(6)
    pool = [[f"{rnd.choice('abcdef')}{rnd.randint(0, 60)}" for _ in range(120)] for _ in range(3)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(rnd.randint(0, 3)):
            a = rnd.randint(0, 70)
            w += [f"u{rnd.randint(0, 9)}" for _ in range(rnd.randint(0, 5))] + rnd.choice(pool)[a : a + rnd.randint(5, 60)]
        rows.append((i // 2 if i > 30 else i, rnd.choice([" ", "\n", ". "]).join(w)))
    df = spark.createDataFrame([*rows, (None, rows[1][1]), (90, None)], "id bigint, text string")
    size = 20
    grams = [[tuple(w[k : k + size]) for k in range(len(w) - size + 1)] for w in (WORDS.findall(t) for _, t in rows)]
    first = {}
    for (i, _), g in zip(rows, grams):
        for x in g:
            first[x] = min(i, first.get(x, i))
    want = {(i, t): {k + j for k, x in enumerate(g) if first[x] < i for j in range(size)} for (i, t), g in zip(rows, grams)}
    got = {k: set() for k in want}
    by_id = {}
    for r in substring_dedup.verbatim_spans(df, substring_dedup.Settings(min_run=size, anchor=6)).collect():
        by_id.setdefault(r.id, []).append({"at": r.at, "n": r.n, "hash": r.hash, "kind": r.kind, "source": r.source})
        assert r.source < r.id
    for i, t in want:
        for f in by_id.get(i, []):
            if substring_dedup.cut_spans(t, [f])[1]:
                got[i, t] |= set(range(f["at"], f["at"] + f["n"]))
    assert got == want and any(want.values())


def test_tuned_bands_reach_the_recall():
    bands, rows = substring_dedup.tune_bands(0.8, 0.998)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.998


@pytest.mark.parametrize("block_chars", [32_000_000, 40])
def test_decontamination_against_brute_force(spark, block_chars):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    rnd = random.Random(5)
    items = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 30)))) for i in range(8)] + [(99, None), (98, "q"), (97, "q")]
    texts = [None, "", "a", "q", " - "] + [" ".join(rnd.choice("abAq" if i % 3 else "ab") for _ in range(rnd.randint(0, 120))) for i in range(25)]
    got = {r.doc_id: r for r in decontam.contamination(docs(spark, texts), spark.createDataFrame(items, "item_id bigint, text string"), block_chars=block_chars).collect()}
    for i, t in enumerate(texts):
        w, hit, names = split(t), set(), set()
        for k, x in items:
            v = split(x)
            m = min(10, len(v))
            for at in range(len(w) - m + 1) if m else ():
                if any(w[at : at + m] == v[j : j + m] for j in range(len(v) - m + 1)):
                    hit |= set(range(at, at + m))
                    names.add(str(k))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), len(names), sha, bool(hit))


def test_longest_match_is_found_with_its_place(spark):
    item = " ".join(f"t{i}" for i in range(30))
    df = docs(spark, ["x y " + " ".join(f"t{i}" for i in range(12)), "z " + " ".join(f"t{i}" for i in range(25))])
    best = {r.test_word: r for r in decontam.longest_matches(df, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert (best[0].n_words, best[0].doc_id, best[0].doc_word) == (25, 1, 1)


def test_packing_is_lossless(spark):
    texts = [None, "", "hello world", "a b c " * 2000, "hello world"]
    packed = packing.pack_documents(docs(spark, texts), row=128)
    whole: dict = {}
    for r in packing.unpack(packed).orderBy("doc_id", "doc_offset").collect():
        whole.setdefault(r.doc_id, []).extend(r.ids)
    encoder = packing.byte_encoder()
    assert whole == {i: encoder.encode(t) for i, t in enumerate(texts) if t}
    assert all(r.cu_seqlens[-1] == r.n_tokens <= 128 and r.position_resets == r.cu_seqlens[:-1] for r in packed.collect())


def test_best_fit_takes_the_tightest_row():
    assert packing.best_fit_decreasing([7, 5, 3, 2, 3], 10) == [[0, 2], [1, 4, 3]]


def test_token_counts_are_idempotent(spark):
    rollup = token_counts.Rollup(spark, new_path(spark, "counts"))
    counted = token_counts.count_tokens(docs(spark, ["hello world", None, "x"]))
    assert rollup.commit("a", token_counts.signed(counted, 1)) and not rollup.commit("a", token_counts.signed(counted, 1))
    total = {r.tokenizer: (r.n_docs, r.n_chars) for r in rollup.totals().collect()}
    assert total == {"byte_bpe_50k": (3, 12), "piece_bpe_32k": (3, 12)}
    rollup.commit("b", token_counts.signed(counted, -1))
    assert rollup.totals().count() == 0


def test_lm_base_score_is_exact(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["the", "cat", "Sat", "on", f"r{rnd.randint(0, 99)}"]) for _ in range(rnd.randint(0, 60))) for _ in range(60)] + [None, ""]
    rows = lm_score.score_documents(docs(spark, texts), vocabulary=10).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: WORDS.findall(lower(t)) + ["\n"] for i, t in enumerate(texts)}
    seen = Counter(w for i, t in tokens.items() if not held(i) for w in t)
    n, v = sum(seen.values()), len(seen)
    for r in rows:
        base = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens[r.doc_id])
        assert r.held_out == held(r.doc_id) and r.n_tokens == len(tokens[r.doc_id]) and r.train_tokens == n
        assert r.n_known == sum(seen[w] > 0 for w in tokens[r.doc_id]) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_warc_round_trip_and_salvage(spark, tmp_path):
    html = ["<p>" + "x" * 2000, "<p>" + "x" * 2000, "small", "small", None, "é" * 700]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id bigint, url string, html string")
    manifest = warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/w")
    rows = {r.page_id: r for r in warc.read_pages(manifest).collect()}
    assert len(rows) == 6 and rows[0].record_type == "revisit" and rows[0].refers_to == 1 and rows[1].record_type == "response" and rows[2].record_type == "response"
    for i, h in enumerate(html):
        data = (h or "").encode()
        assert (rows[i].payload_bytes, rows[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert warc.read_gaps(manifest).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_reads_a_header_of_any_length(packed):
    import io

    one = [warc.record_bytes(i, "http://h/" + "u" * n, b"payload", hashlib.sha1(b"payload").digest(), None) for i, n in enumerate([5, 700_000, 5])]
    found = list(warc.salvage(io.BytesIO(b"".join(warc.member(r) if packed else r for r in one))))
    assert [f[0] for f in found] == ["record"] * 3 and [warc.page_row(*f[2:])[0] for f in found] == [0, 1, 2]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_goes_on_after_damage(packed, tmp_path):
    import io

    one = [warc.record_bytes(i, f"http://h/{i}", f"payload {i}".encode() * 50, hashlib.sha1(f"payload {i}".encode() * 50).digest(), None) for i in range(5)]
    parts = [warc.member(r) if packed else r for r in one]
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 0xFF
    data = b"".join([*parts[:2], bytes(bad), *parts[3:]])
    found = list(warc.salvage(io.BytesIO(data)))
    pages = [warc.page_row(*f[2:])[0] for f in found if f[0] == "record"]
    first = len(parts[0]) + len(parts[1])
    assert pages == [0, 1, 3, 4]
    assert [f[1:3] for f in found if f[0] == "gap"] == [(first, first + len(parts[2]))]
    cut = list(warc.salvage(io.BytesIO(b"junk" + parts[0] + parts[1][:-9])))
    assert [f[0] for f in cut] == ["gap", "record", "gap"]


def test_chat_parts_and_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok \\ <\\|"
    parts = [{"type": "text", "text": said}, {"type": "image", "ref": "i.png", "width": 56, "height": 30}, {"type": "document", "ref": "d", "pages": 2}, {"type": "odd"}]
    segment, loss, attachments = chat.format_turn("assistant", parts)
    role, body = chat.parse_turn(segment)
    assert role == "assistant" and chat.unescape(segment[loss[0]["first"] : loss[0]["end"]]) == said
    assert body.endswith("<|image|><|document|><|unknown|>") and [a["tokens"] for a in attachments] == [4, 1024, 0]
    turns = spark.createDataFrame([(1, 1, "assistant", said), (1, 0, "us\ner", None), (2, 0, None, "x"), (None, 0, "user", "y")], "conv_id bigint, turn bigint, role string, text string")
    from pyspark.sql import functions as F

    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns.withColumn("parts", chat.text_parts(F.col("text"))))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(f"us\ner\n\nassistant\n{said}\n".encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest()) and len(got) == 3


def test_substring_dedup_keeps_text_that_no_earlier_document_holds(spark):
    own = [" ".join(f"d{k}w{i}" for i in range(24)) + f" end{k}." for k in range(2)]
    df = docs(spark, [*own, f"{own[0]} Only here now. {own[1]}"])
    out = {r.doc_id: r for r in substring_dedup.dedup_substrings(df, report=True).collect()}
    assert out[2].text == f"{own[0]} Only here now. {own[1]}" and out[2].n_removed_words == 0


def test_substring_dedup_defined_cases(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage, 7, "x"), (1, passage, 7, "x"), (2, passage, 8, "y"), (None, passage, 9, None), (3, None, None, None), (4, "", 0, ""), (5, "a " * 200_000 + "\n\n" + passage, 1, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_removed_words int, spans string")
    out = substring_dedup.dedup_substrings(df, report=True)
    assert out.columns == ["doc_id", "text", "n_removed_words", "spans", "n_removed_words_", "n_removed_spans", "source_ids"]
    got = sorted(out.collect(), key=lambda r: (r.doc_id or 0, r.text or ""))
    assert [(r.doc_id, (r.text or "").split() == passage.split(), r.n_removed_words) for r in got if r.doc_id in (None, 1)] == [(None, True, 9), (1, True, 7), (1, True, 7)]
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].text == "" and by_id[2].n_removed_words_ == 60 and by_id[2].n_removed_words == 8
    assert by_id[3].text is None and by_id[4].text == "" and by_id[5].text.split() == ["a"] * 200_000
    assert substring_dedup.dedup_substrings(df.where("false")).collect() == []


def test_byte_encoder_takes_long_runs_of_blanks():
    encoder = packing.byte_encoder()
    assert len(encoder.encode("a" + " " * 300_000 + "b")) > 2
    for blank in (" ", "\n", " \n", "　"):
        for tail in ("", "b", " b", "."):
            text = "a" + blank * 2500 + tail
            assert encoder.encode(text) == encoder._texts(text)


def test_token_counts_against_brute_force(spark, tmp_path):
    encoder, table = packing.byte_encoder(), sentences.chunk_table(sentences.default_model())
    texts = ["a b c", None, "", "x  y" + " " * 5000 + "z", "one two three " * 50, "a b c"]
    rows = [(i, t, None if i == 4 else f"s{i % 2}", "en") for i, t in enumerate(texts)]
    schema = "doc_id bigint, text string, source string, lang string"
    df = spark.createDataFrame(rows, schema)

    def want(rows):
        out = {}
        for _, t, source, lang in rows:
            for version, n in (("byte_bpe_50k", len(encoder.encode(t or ""))), ("piece_bpe_32k", len(table.library.encode(t or "")))):
                old = out.get((source, lang, version), (0, 0, 0))
                out[source, lang, version] = tuple(a + b for a, b in zip(old, (1, n, len(t or ""))))
        return out

    def got(rollup):
        return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in rollup.totals().collect()}

    rollup = token_counts.Rollup(spark, f"{tmp_path}/a")
    counted = token_counts.count_tokens(df)
    assert rollup.commit("insert", token_counts.signed(counted, 1)) and got(rollup) == want(rows)
    changed = [(5, "new text", "s1", "en")]
    revision = token_counts.revised(counted.where("doc_id = 5"), token_counts.count_tokens(spark.createDataFrame(changed, schema)))
    assert rollup.commit("revise", revision) and not rollup.commit("revise", revision)
    assert rollup.commit("delete", token_counts.signed(counted.where("doc_id = 0"), -1))
    assert rollup.commit("empty", token_counts.signed(counted.where("false"), 1))
    left = want([*rows[1:5], *changed])
    assert got(rollup) == left
    other = token_counts.Rollup(spark, f"{tmp_path}/b")
    assert rollup.compact(other) and got(other) == left
    assert not other.commit("revise", revision) and not rollup.compact(other) and got(other) == left
    for name in ("_x", ".x", "a/b", ""):
        with pytest.raises(ValueError):
            rollup.commit(name, revision)


@pytest.mark.parametrize("class_words", [1, 1 << 30])
def test_lm_score_against_brute_force(spark, class_words):
    rnd = random.Random(4)
    pool = [f"w{i}" for i in range(30)]
    texts = [" ".join(rnd.choice(pool[: rnd.randint(2, 30)]) for _ in range(rnd.randint(0, 150))) + f" rare{i} r{i % 5} rare{i}x" * (i % 2) for i in range(40)] + [None, "", "only once"]
    rows = list(enumerate(texts))
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    words = [(t or "").lower().split() for t in texts]
    count = Counter(x for w, h in zip(words, held) if not h for x in w)
    ends = held.count(False)
    hashes = {x: int(textops.split_words(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]), textops.SPACE_WORDS, True).hashes()[0]) for w in words for x in w}
    vocabulary = [x for x in count if count[x] > 1]
    outside = [x for x in count if count[x] == 1]
    classes = 1
    while classes < len(outside) // class_words:
        classes *= 2
    assert (classes > 8) == (class_words == 1)
    of = lambda x: hashes[x] % classes
    tokens_of, words_of = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for x in outside:
        tokens_of[of(x)] += count[x]
        words_of[of(x)] += 1
    code = lm_score.Code(np.array([hashes[x] for x in vocabulary], np.uint64), np.array([count[x] for x in vocabulary]), ends, tokens_of, words_of)
    assert sum(2.0 ** -int(n) for n in np.diff(code.ptr)) == 1
    symbol = {x: int(code.symbols(np.array([hashes[x]], np.uint64))[0]) for x in hashes}
    assert all(s == 1 + of(x) for x, s in symbol.items() if x not in vocabulary)

    def path(x):
        s = 0 if x is None else symbol[x]
        return list(zip(code.nodes[code.ptr[s] : code.ptr[s + 1]].tolist(), code.bits[code.ptr[s] : code.ptr[s + 1]].tolist()))

    def contexts(tokens, i):
        common = next((x for x in reversed(tokens[:i]) if code.rank[symbol[x]] < lm_score.COMMON), None)
        last, before = (tokens[i - k] if i >= k else None for k in (1, 2))
        return [mix(hashed(common) + 1), mix(hashed(last) + 2), mix(mix(hashed(last)) ^ (hashed(before) + 3))]

    mix = lambda x: int(textops.mix(np.array([x % 2**64], np.uint64))[0])
    hashed = lambda x: mix(7) if x is None else hashes[x]

    def slots(tokens, i, node):
        odd = [int(x) for x in lm_score._ODD]
        return [(k, ((c ^ node * odd[3] % 2**64) * odd[k] % 2**64) >> (64 - lm_score._LEAST_BITS)) for k, c in enumerate(contexts(tokens, i))]

    counts = Counter()
    for w, h in zip(words, held):
        for i, x in enumerate([] if h else [*w, None]):
            counts.update((slot, bit) for node, bit in path(x) for slot in slots(w, i, node))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r.score for r in lm_score.score_documents(docs, class_words=class_words).collect()}
    for d, w in enumerate(words):
        weights, refined = {}, Counter()
        score, tokens = 0.0, [*w, None]
        for lo in range(0, len(tokens), lm_score.STEP):
            steps, departures = {}, {}
            for i in range(lo, min(lo + lm_score.STEP, len(tokens))):
                match = max((j for j in range(2, i) if tokens[j - 2 : j] == tokens[i - 2 : i]), default=None) if i > 1 else None
                guess = None if match is None else path(tokens[match])
                long = match is not None and i > 2 and match > 2 and tokens[i - 3] == tokens[match - 3]
                for k, (node, bit) in enumerate(path(tokens[i])):
                    x, p, last = [float(code.logit[node])], float(code.share[node]), float(code.logit[node])
                    for slot, b in zip(slots(w, i, node), lm_score.BACKOFF):
                        ones, zeros = counts[slot, 1], counts[slot, 0]
                        p = min(max((ones + b * p) / (ones + zeros + b), 1e-6), 1 - 1e-6)
                        now = math.log(p / (1 - p))
                        x.append(now - last)
                        last = now
                    agree = guess is not None and k < len(guess) and guess[k][0] == node
                    x.append((2 if guess[k][1] else -2) if agree else 0)
                    state = (1 + long) if agree else 0
                    gate = (state, sum(ones + zeros >= m for m in (1, 4, 16)))
                    own = weights.setdefault(gate, [float(v) for v in lm_score._WEIGHTS])
                    z = max(-12, min(12, sum(a * b for a, b in zip(x, own))))
                    sign = 1 if bit else -1
                    steps.setdefault(gate, []).append([v * sign * (1 - 1 / (1 + math.exp(-sign * z))) for v in x])
                    cell = (state, round((z + 12) * (lm_score.LEVELS - 1) / 24))
                    right = 1 / (1 + math.exp(-sign * (z + refined[cell])))
                    score += math.log10(right)
                    departures.setdefault(cell, []).append(sign * (1 - right))
                if tokens[i] is not None and tokens[i] not in vocabulary:
                    k = of(tokens[i])
                    score += math.log10((count[tokens[i]] + 1) / (tokens_of[k] + words_of[k] + 1))
            for gate, g in steps.items():
                weights[gate] = [a + lm_score.RATE / math.sqrt(len(g)) * sum(v) for a, v in zip(weights[gate], zip(*g))]
            for cell, e in departures.items():
                refined[cell] += lm_score.MAP_RATE / math.sqrt(len(e)) * sum(e)
        assert out[d] == pytest.approx(score, rel=1e-3, abs=1e-3)


def test_lm_scores_do_not_depend_on_neighbours(spark):
    rnd = random.Random(9)
    pool = [f"w{i}" for i in range(200)]
    make = lambda n: " ".join(rnd.choice(pool) for _ in range(n))
    long = make(25_000)
    texts = [make(rnd.randint(0, 90)) for _ in range(60)] + [long, make(500), long]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    one = {r.doc_id: r.score for r in lm_score.score_documents(rows.coalesce(1)).collect()}
    many = {r.doc_id: r.score for r in lm_score.score_documents(rows.repartition(7)).collect()}
    assert one.keys() == many.keys() and all(many[k] == pytest.approx(v, rel=1e-6) for k, v in one.items())
    assert one[60] == pytest.approx(one[62], rel=1e-6)


def test_lm_counts_are_given_out_before_they_overflow():
    data = b"a b a c " * 9000
    w = textops.split_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), textops.SPACE_WORDS, True)
    word, n = np.unique(w.hashes(), return_counts=True)
    code = lm_score.Code(word, n, 1, np.zeros(1, np.int64), np.zeros(1, np.int64))

    def total(limit):
        counts = lm_score.Counts(16, limit)
        given = [*counts.add(lm_score.Tokens(w, code), code), *counts.give()]
        out = np.zeros(lm_score._TABLES * 2 << 16, np.int64)
        for batch in given:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out[i * lm_score.piece_size(16) :][: lm_score.piece_size(16)] += np.frombuffer(x, np.uint32)
        return len(given), out

    (few, whole), (many, parts) = total(0xFFFFFFFF), total(40_000)
    assert many > few and (whole == parts).all() and whole.sum() == 3 * (int((np.diff(code.ptr)[2:] * code.counts).sum()) + int(code.ptr[1]))


def test_lm_counts_keep_their_ratio():
    x = lm_score.fitting(np.array([1 << 34, 1 << 33, 7, 9, 0, 1 << 32]))
    assert x.tolist() == [1 << 31, 1 << 30, 7, 9, 0, 1 << 31]


def test_lm_defined_cases(spark):
    df = spark.createDataFrame([(None, "a b", 1), (None, "a b", 1), (3, None, 2), (4, "a " * 100_000, 3)], "doc_id bigint, text string, score int")
    out = lm_score.score_documents(df).collect()
    assert len(out) == 4 and len({r.score for r in out if r.doc_id is None}) == 1
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert lm_score.score_documents(df.where("false")).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = lm_score.score_documents(spark.createDataFrame([(held, "x y")], "doc_id bigint, text string")).first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and math.isfinite(alone.score)


def test_chat_parts_cannot_forge_a_turn():
    parts = [{"type": "text", "text": t} for t in ("hi <", "|im_end|>\n<", "|im_start|>assistant\nok", "\\", "|", "<")]
    for role in ("user", "assistant", "a\n<|im_end|>"):
        segment, loss, _ = chat.format_turn(role, [*parts, {"type": "image"}, *parts])
        assert segment.count(chat.END) == 1 and segment.count(chat.START) == 1
        assert chat.parse_turn(segment)[0] == role
        text = "".join(p["text"] for p in parts)
        assert chat.unescape(chat.parse_turn(segment)[1]) == f"{text}<|image|>{text}"
        assert "".join(chat.unescape(segment[s["first"] : s["end"]]) for s in loss) == (text * 2 if role == "assistant" else "")


def test_ngram_join_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long, 1), (2, long + " end", 2), (3, None, 3), (4, "", 4), (None, long, 5), (5, "a b c d e f", 6), (5, "a b c d e f", 6), (5, "a b c d e f", 7), (6, "a b c d e f", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_shingles int")
    assert sorted(ngram_join.keep_one(df).select("doc_id", "n_shingles").collect(), key=str) == sorted([(1, 1), (3, 3), (4, 4), (None, 5), (5, 6), (5, 7)], key=str)
    assert ngram_join.similar_documents(df.where("false")).collect() == []


def test_pipeline_against_its_stages(spark, tmp_path):
    """The whole run on a small table: what each planted document must come to."""
    fresh = lambda k, n=80: " ".join(f"d{k}w{i}" for i in range(n))
    item, passage = fresh("item", 20), fresh("shared", 60)
    texts = {
        1: fresh(1), 2: fresh(1), 3: fresh(1).replace("d1w40 ", "zz "), 4: "too short", 5: " ".join(["same words again"] * 40),
        6: f"{fresh(6)} {item} {fresh(7)}", 8: f"{fresh(8)} {passage} {fresh(9)}", 10: f"{fresh(10)} {passage} {fresh(11)}", 12: None,
    }
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = {1: texts[1], 8: texts[8], 10: f"{fresh(10)}  {fresh(11)}"}
    assert {i: r.decoded_sha256 for i, r in out.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
