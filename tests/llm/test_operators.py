"""Odd rows for each operator, and brute-force or library versions where SQL has none."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
import corpus_pipeline
from check_oracle import compare
from signalgrid.llm import (
    chat, elias_fano, embedding_dedup, language_model, license_scan, minhash_dedup, packing, quality, queries,
    token_counts, warc, words,
)
from signalgrid.llm.common import components

LONG = " ".join(f"Wort{i % 977}" for i in range(30_000))
TEXTS = [None, "", " \n\t", "a", "A  b\n\n c", LONG, LONG, "MIT License; Apache License", "don't 're 's", "ﬁ Å İK ſ",
         "x<|endoftext|>y", "日本 x", "one two three four", "one two three four"]
DOCS = "doc_id long, text string, score string, label string, quality string, key string, n string"


@pytest.fixture
def docs(spark):
    rows = [(i, t, "s", "l", "q", "k", "n") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], (None, "a", *"slqkn"), (None, None, *"slqkn")], DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in spark_entry.oracle_sql()])
def test_query_equals_sql(spark, sf_dir, name):
    good, note = compare(spark, sf_dir, name)
    assert good, note


def test_components_against_search(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(200, 240)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]
    pairs += [(None, 3), (7, 7), (300, 299), (300, 298), (300, 297)]
    near = {}
    for a, b in pairs:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    wanted = {}
    for i in sorted(near):
        todo = [] if i in wanted else [i]
        while todo:
            x = todo.pop()
            if x not in wanted:
                wanted[x] = i
                todo += near[x]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == wanted


def test_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.001], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1),
            (8, [float("nan"), 1.0, 2.0], 1), (9, [1.0, None, 2.0], 1), (10, [float("inf"), 1.0, 1.0], 1), (11, [], 1),
            (12, [-1.0, -2.0, -3.0], 1), (13, [1.0, 2.0], 1), (None, v, 1), (14, [1e300, 2e300, 3e300], 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.vector_links(frame).collect()}
    assert {i: got[i][:2] for i in (1, 2, 3, 14)} == {i: (3, 1) for i in (1, 2, 3, 14)}
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13)) and got[None] == (0, None, False)
    assert embedding_dedup.vector_links(frame.limit(0)).count() == 0


def test_blocks_of_a_busy_bucket_hold_each_pair_once(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(16) + 0.04 * rng.standard_normal((120, 16))
    frame = spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = ((unit @ unit.T >= 0.98).sum(axis=1) - 1).tolist()
    got = {r.vec_id: r.n_links for r in embedding_dedup.vector_links(frame, block=25).collect()}
    assert [got[i] for i in range(120)] == wanted


def test_classifier(spark, docs, no_docs, sf_dir):
    labels = spark.createDataFrame([(0, 1), (3, 0), (3, 0), (7, None), (8, 5), (99, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(no_docs, labels).count() == 0


def test_classifier_on_held_out_rows(spark):
    big = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{big}/labels.parquet").to_pylist()}
    got = [r for r in queries.op2_quality_classifier(spark, big).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in got) / len(got) > 0.99


def test_chat_round_trip(spark):
    odd = ["", "<|end|>\n<|turn|>x<|text|>", "a\\b\\\\", "</s>[INST] <<SYS>> <s> <|", "\\<|", "é\U0001F600\n"]
    for role in odd:
        for text in odd:
            made = chat.format_message(role, [{"text": text}])
            assert chat.read_messages(made["formatted"]) == [(role, [text])]
    parts = [{"kind": "text", "text": "see"}, {"kind": "image", "uri": "u", "width": 28, "height": 15},
             {"kind": "audio", "uri": "v", "seconds": 1.5}, {"kind": "document", "pages": 2}, {"kind": "?", "text": "!"}, {}]
    made = chat.format_message("assistant", parts)
    assert [(a["kind"], a["tokens"], a["placeholder"]) for a in made["attachments"]] == [
        ("image", 4, "<|image 1|>"), ("audio", 38, "<|audio 2|>"), ("document", 2048, "<|document 3|>")]
    assert [made["formatted"][s["begin"]:s["end"]] for s in made["loss"]] == ["see", "!"] and made["expanded_tokens"] == 2090
    rows = [(1, 1, "assistant", None), (1, 0, None, "q"), (1, None, "user", "z"), (None, 0, "user", "x"), (1, 1, "assistant", None)]
    frame = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(frame)).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 0 and got[None].n_turns == 1
    assert chat.read_back(chat.format_turns(frame.limit(0))).count() == 0


def test_token_counts_at_every_prefix(spark, docs, no_docs):
    from tokenizers import Tokenizer

    path = token_counts.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)

    def count(text):
        return len(library.encode(text, add_special_tokens=False).ids)

    own, rng = token_counts.counter(path), random.Random(4)
    made = ["".join(rng.choice("ab' \n\t.,1é日s're<|endoftext|>") for _ in range(rng.randrange(16))) for _ in range(300)]
    for text in [t for t in TEXTS if t and t != LONG] + made:
        assert own.prefixes(text).tolist() == [count(text[:k]) for k in range(len(text) + 1)], repr(text)
        assert own.count(text) == count(text)
    got = token_counts.token_counts(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        text = (TEXTS[r.doc_id] or "") if r.doc_id is not None else None
        if text is not None:
            assert (r.n_bytes, r.n_tokens) == (len(text.encode()), count(text)) and r.over_limit == (r.n_tokens > 1024)
    cut = {r.doc_id: r.text for r in token_counts.truncated(docs, 2).collect()}
    assert all(count(t) <= 2 for t in cut.values()) and cut[12] == "one two"
    assert token_counts.token_counts(no_docs).count() == 0


def test_prefix_counts_of_long_runs(spark):
    from tokenizers import Tokenizer

    path = token_counts.vocabulary("byte_bpe_50k.json")
    library, own, rng = Tokenizer.from_file(path), token_counts.counter(path), random.Random(6)
    for text in (" " * 1_000_000, " " * 200_000 + "x", "'" * 100_000, "'r" * 50_000, " \n\u3000" * 20_000 + "'re", "a<|endof" * 9_000):
        counts = own.prefixes(text)
        for k in [0, 1, len(text) - 1, len(text), *(rng.randrange(min(len(text), 30_000)) for _ in range(8))]:
            assert counts[k] == len(library.encode(text[:k], add_special_tokens=False).ids)
    own.forget()
    frame = spark.createDataFrame([(1, "one two"), (2, None), (3, " " * 9)], "doc_id long, text string")
    for budget in (-3, 0):
        assert {r.text for r in token_counts.truncated(frame, budget).collect()} == {""}


def plainly_fitted(rows, labels, share, size, cost, epochs):
    """Naive Bayes ratios and dual coordinate descent, one number at a time."""
    counts = {0: [1.0] * size, 1: [1.0] * size}
    for row, label in zip(rows, labels):
        for j in row:
            counts[label][j] += 1
    ratio = [math.log(counts[1][j] / sum(counts[1])) - math.log(counts[0][j] / sum(counts[0])) for j in range(size)]
    part = sum(labels) / len(labels)
    weights, dual, order = [0.0] * (size + 1), [0.0] * len(rows), np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            y = 1 if labels[i] else -1
            most = cost * (share / part if labels[i] else (1 - share) / (1 - part))
            value = weights[size] + sum(weights[j] * ratio[j] for j in rows[i])
            square = 1 + sum(ratio[j] ** 2 for j in rows[i])
            new = min(max(dual[i] + (1 - y * value) / square, 0), most)
            for j in rows[i]:
                weights[j] += (new - dual[i]) * y * ratio[j]
            weights[size] += (new - dual[i]) * y
            dual[i] = new
    return [w * r for w, r in zip(weights, [*ratio, 1])], dual


def test_fit_against_plain_loops(monkeypatch):
    rng, size = random.Random(3), 60
    monkeypatch.setattr(quality, "SIZE", size)
    labels = [int(rng.random() < 0.4) for _ in range(50)]
    rows = [sorted({int(rng.triangular(0, size, size * 0.7 if y else size * 0.3)) for _ in range(12)}) for y in labels]
    for share, epochs in ((0.4, 3), (0.7, 400)):
        wanted, dual = plainly_fitted(rows, labels, share, size, 0.1, epochs)
        got = quality.fit([np.array(r) for r in rows], np.array(labels), share, 0.1, epochs)
        assert np.allclose(got, wanted, rtol=1e-9, atol=1e-12)
    # At the end the margins fit the duals: beyond 1 where one is zero, within where it is at its bound.
    part = sum(labels) / len(labels)
    for row, y, a in zip(rows, labels, dual):
        margin = (1 if y else -1) * (got[size] + sum(got[j] for j in row))
        most = 0.1 * (0.7 / part if y else 0.3 / (1 - part))
        assert margin > 1 - 1e-3 if a <= 0 else margin < 1 + 1e-3 if a >= most else abs(margin - 1) < 1e-3


def test_warc_odd_pages(spark):
    big = "x\r\n\r\n" * 400
    rows = [(1, "http://a/ü\r\nb", big), (2, None, big), (2, "u", big), (None, "u", big), (3, "u", None), (4, "u", ""), (5, "u", "é"),
            (6, "u", "é"), (1, "http://a/ü\r\nb", big)]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, file string")
    index = warc.write_archives(pages, archive_bytes=300)
    assert index.select("file").distinct().count() > 1
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_records(index).collect())
    n = len(big.encode())
    assert got == Counter({(1, n, "revisit", 2): 2, (2, n, "response", None): 2, (None, n, "revisit", 2): 1, (3, 0, "response", None): 1,
                           (4, 0, "response", None): 1, (5, 2, "response", None): 1, (6, 2, "response", None): 1})
    one = warc.read_records(index.where("page_id = 5")).collect()
    assert [bytes(r.payload) for r in one] == ["é".encode()]
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


def test_near_duplicates_of_odd_texts(spark, docs, no_docs):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got[5, 981 - 4] == (5, True) and got[6, 977] == (5, False) and got[12, 1] == (12, True) and got[13, 1] == (12, False)
    assert got[0, 0] == (0, True) and got[1, 0] == (1, True) and got[None, 0] == (None, False) and got[None, 1] == (None, False)
    assert minhash_dedup.near_duplicates(no_docs).count() == 0


def test_sketch_threshold():
    rng = np.random.default_rng(0)
    for share in (0.8, 0.75):
        common = rng.integers(0, 2**63, int(800 * share), dtype=np.uint64)
        rest = (800 - len(common)) // 2
        a, b = (np.concatenate((common, rng.integers(0, 2**63, rest, dtype=np.uint64))) for _ in range(2))
        sketch = minhash_dedup.odd_sketches(np.stack((minhash_dedup.minhash(a), minhash_dedup.minhash(b))))
        assert np.bitwise_count(sketch[0] ^ sketch[1]).sum() <= minhash_dedup.most_differing()


def test_packing(spark, docs, no_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.vocabulary("word_bpe_49k.json"))
    rows = packing.packed(docs, keep_ids=True, window=256).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.ids))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in enumerate(TEXTS):
        if i == 3:  # a repeated row
            assert sorted(p[1] for p in by_doc[i]) == sorted([[*library.encode("a", add_special_tokens=False).ids, 1]] * 2)
        else:
            assert sum((ids for _, ids in sorted(by_doc[i])), []) == [*library.encode(text or "", add_special_tokens=False).ids, 1]
    for parts in by_sequence.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 256
    assert packing.packed(no_docs).count() == 0


def word_ids(own, texts):
    return [ids[a:b].tolist() for _, ids, at in own.texts(pa.array(texts, pa.string())) for a, b in zip(at, at[1:])]


def test_word_ids_of_odd_runs(monkeypatch):
    own, rng = packing.WordIds(token_counts.vocabulary("word_bpe_49k.json")), random.Random(4)
    parts = ["a", "B", "the", "tion", "don't", "'", "\u2019S", "É", "ß", "ÿ", "Ÿ", "×", "÷", "İ", "K", "e\u0301", "23", "٣", "½", "º",
             "_", "--", "!?", "=" * 30, "<|", "|>", "<|endoftext|>", "日本", "Привет", "😀", "\x85", "\x1c", "\x1f", "\0", "\u2003",
             " ", " ", "\n", "\t", "\v", "\f", "wordWord" * 3, "wordWord" * 3 + "s", "wordWording", "É" * 13]
    texts = [None, "", "é\0 é \0 \0\0", *("".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(400)), "one  two " * 99, "x" * 999]
    wanted = [own.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert word_ids(own, texts) == wanted == word_ids(own, texts)
    monkeypatch.setattr(packing, "TEXT_BYTES", 50)  # long texts are cut at blanks
    monkeypatch.setattr(packing, "CACHED", 20)
    monkeypatch.setattr(packing, "mix", lambda x: x * np.uint64(0))  # words of equal first letters share a hash
    assert word_ids(own, texts) == wanted


def test_a_word_is_merged_once(monkeypatch):
    own, merged = packing.WordIds(token_counts.vocabulary("word_bpe_49k.json")), []
    merge = own._merge
    monkeypatch.setattr(own, "_merge", lambda words, *rest: merged.append(len(words)) or merge(words, *rest))
    words = ["".join(chr(97 + i // 26 ** k % 26) for k in range(4)) for i in range(120_000)]
    for _ in range(3):
        word_ids(own, [" ".join(words[i:i + 10_000]) for i in range(0, len(words), 10_000)])
        word_ids(own, [", ".join(words[i:i + 10_000]).title() for i in range(0, len(words), 10_000)])
    assert sum(merged) == len(words) + 1  # the comma


def test_fillings_are_the_closest():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 7))}
        taken = packing.fill(dict(counts), 50)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= 50}
        longest = max(counts)
        best = max(s for s in sums)
        total = sum(n * k for n, k in taken.items())
        assert taken[longest] >= 1 and all(taken[n] <= counts[n] for n in taken) and total <= 50
        if best == 50 and total < 50:  # the longest length is always taken
            rest = {0}
            for n, c in counts.items():
                rest = {s + n * k for s in rest for k in range(c + 1 - (n == longest)) if s + n * k <= 50 - longest}
            assert total == longest + max(rest)
    lengths = {n: 3 * n % 7 + 1 for n in range(1, 257)}
    used = Counter()
    for n, _, ranks, *_ in packing.plan(lengths, 256):
        used[n] += ranks
    assert used == Counter(lengths)


def test_licenses_in_odd_texts(spark, docs, no_docs):
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert (got[7].n_words, got[7].n_base, got[7].first_word, got[7].last_word, got[7].base_labels) == (4, 2, 0, 2, "apache,mit")
    assert (got[0].n_words, got[0].labels, got[0].score) == (0, "", 0.0) and license_scan.license_scan(docs).count() == docs.count()
    whole = spark.createDataFrame([(1, "Foo " + license_scan.TEXTS["mit-text"].upper()), (2, "permission is hereby")], "doc_id long, text string")
    found = {r.doc_id: (r.labels, r.score) for r in license_scan.license_scan(whole).collect()}
    assert found == {1: ("mit-text", 1.0), 2: ("", 0.0)}
    twice = spark.createDataFrame([(1, "mit license " * 3), (1, "apache license"), (1, "apache license")], "doc_id long, text string")
    found = sorted((r.n_base, r.first_word, r.last_word, r.labels) for r in license_scan.license_scan(twice).collect())
    assert found == [(1, 0, 0, "apache"), (1, 0, 0, "apache"), (3, 0, 4, "mit")]
    assert license_scan.license_scan(no_docs).count() == 0


def found_licenses(words):
    """Labels and best share by plain loops over a text's words."""
    shares = {}
    for label, base, due in license_scan.templates():
        if base:
            shares.update({label: 1.0 for p in range(len(words)) if words[p:p + len(due)] == due})
            continue
        places = {}
        for p in range(len(words) - 3):
            for q in range(len(due) - 3):
                if words[p:p + 4] == due[q:q + 4]:
                    places.setdefault(p - q, set()).update(
                        q + i for i in range(-4, 8) if 0 <= q + i < len(due) and 0 <= p + i < len(words) and words[p + i] == due[q + i])
        spans = []
        for d in sorted(places):
            if not spans or d - spans[-1][-1] > 3:
                spans.append([])
            spans[-1].append(d)
        for span in spans:
            at = [d + q for d in span for q in places[d]]
            share = len(set().union(*(places[d] for d in span))) / len(due)
            if share >= 0.5 and max(at) - min(at) + 1 <= 2 * len(due):
                shares[label] = max(share, shares.get(label, 0))
    return ",".join(sorted(shares)), max(shares.values(), default=0.0)


def test_licenses_against_plain_loops(spark):
    rng = random.Random(12)
    due = [words for _, _, words in license_scan.templates()]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randrange(1, 4)):
            part = list(rng.choice(due))
            for _ in range(rng.choice([0, 1, len(part) // 12, len(part) // 5])):
                k, what = rng.randrange(len(part) + 1), rng.choice(["the", "software", "x", ""])
                part[k:k + rng.randrange(3)] = [what] if what else []
            begin, end = sorted((rng.choice([0, rng.randrange(len(part) + 1)]), rng.choice([len(part), rng.randrange(len(part) + 1)])))
            text += ["y"] * rng.randrange(3) + part[begin:end] * rng.choice([1, 1, 2])
        rows.append((i, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in license_scan.license_scan(frame).collect()}
    wanted = {i: found_licenses(text.split()) for i, text in rows}
    assert got == {i: (labels, round(score, 9)) for i, (labels, score) in wanted.items()}
    assert len({labels for labels, _ in wanted.values()}) > 12


def test_licenses_stay_in_the_jvm(spark, sf_dir, capsys):
    queries.op9_license_scan(spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian"))


def test_license_scan_cuts_each_text_once_a_scan(spark, sf_dir):
    scan = license_scan.license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = scan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") == 2 and len(re.findall(r"regexp_extract_all\(|split\(", plan)) == 2


def test_words_are_runs_between_plain_signs(spark):
    texts = [None, "", " \n\t", "a", "-a", "b-", "--", "a--B  c", "\x00x\x7fy", "a1_b{c}d@e`f[G]^h:i/0", "ß\u00a0ü 日本,x", "\U0001f600 x\U0001f600y", LONG]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.words for r in license_scan.with_words(rows, F.col("i")).collect()}
    between = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    assert got == {i: between.findall((t or "").lower()) for i, t in enumerate(texts)}


def test_language_model_against_counting(spark, docs, no_docs):
    got = language_model.scored(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    def tokens(text):
        return [*(text or "").encode().lower().split(), None]

    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    count, pairs, n_docs = Counter(), Counter(), 0
    for i, text in rows:
        if not held(i):
            t = tokens(text)
            count.update(t)
            pairs.update(zip(["<b>", *t[:-1]], t))
            n_docs += 1
    n, v = sum(count.values()), len(count)
    kept = {p: c for p, c in pairs.items() if c >= 2}
    total = {**count, "<b>": n_docs}
    back = Counter()
    for (a, _), c in kept.items():
        back[a] += (c - 0.75) / total[a]
    wanted = Counter()
    for i, text in rows:
        t = tokens(text)
        base = sum(np.log10((count[w] + 1) / (n + v + 1)) for w in t)
        score = sum(np.log10((kept[a, w] - 0.75) / total[a] * ((a, w) in kept) if (a, w) in kept else 0
                             + 0.0 + max(1 - back[a], 1e-9) * (count[w] + 1) / (n + v + 1)) if (a, w) not in kept else
                    np.log10((kept[a, w] - 0.75) / total[a] + max(1 - back[a], 1e-9) * (count[w] + 1) / (n + v + 1))
                    for a, w in zip(["<b>", *t[:-1]], t))
        wanted[i, held(i), len(t), sum(count[w] > 0 for w in t), round(base, 4), round(score / len(t), 2)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score / r.n_tokens, 2)) for r in got) == wanted
    assert {r.train_tokens for r in got} == {n}
    assert language_model.scored(no_docs).count() == 0


def test_pairs_behind_a_refused_closest_pair_are_asked(spark):
    word = [f"w{i}" for i in range(130)]
    # 1 - 2 - 4 - 3 are a chain of neighbours at 0.81; sketches put the far ends 1 and 3 closest.
    texts = {1: word[:100], 2: word[10:110], 4: word[20:120], 3: word[30:130], 9: ["x"] * 100}
    sketch = {1: [0] * 16, 2: [1] + [0] * 15, 4: [2] + [0] * 15, 3: [0] * 16, 9: [-1] * 16}
    buckets = {10: [1, 3], 11: [1, 2], 12: [3, 4], 13: [1, 2, 3, 4, 9], **{k: [9] + [100 + k] for k in range(20, 30)}}
    for k in range(20, 30):  # others that make 9 the hub of bucket 13
        texts[100 + k], sketch[100 + k] = [f"y{k}"] * 100, [(1 << 62) - 1 - k if j % 2 else k for j in range(16)]
    # All rows have as many bands; where a row is in no bucket with others, its key is its own.
    rows = [(i, 96, [k if i in m else -1000 * i - k for k, m in buckets.items()], sketch[i]) for i in texts]
    reps = spark.createDataFrame(rows, "rep long, n long, bands array<long>, sketch array<long>")
    documents = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    links = {(min(r.a, r.b), max(r.a, r.b)) for r in minhash_dedup._links(reps, documents).collect()}
    assert {(1, 2), (3, 4), (2, 4)} <= links and (1, 3) not in links


def test_language_model_query_keeps_pairs_seen_once(spark, sf_dir):
    got = {r.doc_id: r.score for r in queries.op10_language_model(spark, sf_dir).collect()}
    rows = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    tokens = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), None] for r in rows}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["<b>", *t[:-1]], t))
    n, v, total = sum(count.values()), len(count), {**count, "<b>": len(train)}
    back = Counter()
    for (a, _), c in pairs.items():
        back[a] += (c - 0.75) / total[a]
    assert sum(c == 1 for c in pairs.values()) > len(pairs) / 2 and len(got) == len(rows)
    for i, t in tokens.items():
        wanted = 0.0
        for a, w in zip(["<b>", *t[:-1]], t):
            alone = (count[w] + 1) / (n + v + 1)
            share = (pairs[a, w] - 0.75) / total[a] if (a, w) in pairs else 0.0
            wanted += np.log10(share + max(1 - back[a], 1e-9) * alone)
        assert abs(got[i] - wanted) < 1e-3 * len(t), i


def test_coded_sequences():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 0), (7, 3), (2000, 1 << 62), (3000, 3000)):
        values = np.sort(rng.integers(0, top, n, endpoint=True).astype(np.uint64))
        own = elias_fano.Sequence(elias_fano.encode(values))
        x = np.concatenate((rng.integers(0, top + 2, 200).astype(np.uint64), values[:50]))
        place, hit = own.successor(x)
        assert (place == np.searchsorted(values, x)).all() and (hit == np.isin(x, values)).all()
        if n:
            assert (own.at(np.arange(n)) == values).all()


def test_word_keys_follow_the_definition():
    texts = ["A b\x0bC", None, "", " x ", "é Y z", "ab", "a b"]
    for most in (1, 5, 1_000):
        found = [keys for block in words.blocks(pa.array(texts), most=most) for _, keys in block.documents()]
        split = [(t or "").encode().lower().split() for t in texts]
        assert [len(k) for k in found] == [len(s) for s in split]
        key = {w: k for s, ks in zip(split, found) for w, k in zip(s, ks.tolist())}
        assert len(set(key.values())) == len(key)
        assert all(key[w] == k for s, ks in zip(split, found) for w, k in zip(s, ks.tolist()))


def test_pipeline_stages(spark, docs, sf_dir):
    found = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, sf_dir)
        assert found.columns == docs.columns, name
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, found, sf_dir).collect()} <= {*range(len(TEXTS)), None}


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    documents = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    kept = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    groups = minhash_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in groups if r.kept or r.n_shingles == 0} <= set(documents)


def test_nearly_similar_families_leave_no_pairs_behind(spark):
    """Texts that are all near each other, but under the threshold, with real groups among them."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]

    def changed(words, k):
        out = list(words)
        for i in rng.sample(range(len(out)), k):
            out[i] = f"z{rng.random()}"
        return out

    texts = [changed(base, 3) for _ in range(160)]
    texts += [changed(t, 1) for t in texts[:60]] + [changed(t, 2) for t in texts[:20]] + texts[:5]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    near = {i: {j for j in range(len(sets)) if i != j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
            for i in range(len(sets))}
    component = {}
    for i in range(len(sets)):
        todo = [] if i in component else [i]
        while todo:
            x = todo.pop()
            if x not in component:
                component[x] = i
                todo += near[x]
    assert 60 < len(set(component.values())) < 200
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(frame).collect()}
    assert got == component
    reps = minhash_dedup.sketches(frame).where("n_shingles > 0").dropDuplicates(["class"]).selectExpr(
        "doc_id AS rep", "n_shingles AS n", "bands", "sketch")
    assert minhash_dedup._links(reps, frame).count() < 6 * len(docs)


def test_recall_at_the_threshold_with_the_sketch():
    """Pairs at 0.75 that bands bring together and the sketch then drops."""
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(400):
        keys = rng.integers(0, 2**63, 700).astype(np.uint64)
        a, b = keys[:600], keys[100:]  # 500 of 700 in common
        both = minhash_dedup.odd_sketches(np.stack((minhash_dedup.minhash(a), minhash_dedup.minhash(b))))
        missed += int(np.bitwise_count(both[0] ^ both[1]).sum()) > minhash_dedup.most_differing()
    assert missed == 0


def test_words_of_long_texts_have_the_same_keys(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é \n") for _ in range(400)), "x" * 900, " " * 300, "", None, "a " * 200, "y" * 65 + " z" * 70]
    whole = [b.keys.tolist() for b in words.blocks(pa.array(texts))]
    monkeypatch.setattr(words, "STRETCH", 64)
    assert [b.keys.tolist() for b in words.blocks(pa.array(texts))] == whole


def test_a_worker_keeps_nothing_of_a_long_text():
    import resource

    text = pa.array(["Wort einer langen Zeile\n" * 2_200_000])  # 50 MB
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = sum(len(b.keys) for b in words.blocks(text))
    assert n == 8_800_000
    held = int(open("/proc/self/statm").read().split()[1]) * 4096 / 1024
    assert held - before < 200_000  # kB
    found = list(quality.features(text))
    assert len(found) == 1 and len(np.unique(found[0])) == len(found[0])


def test_grams_of_a_long_text_are_those_of_its_stretches(monkeypatch):
    rng = random.Random(5)
    texts = pa.array(["".join(rng.choice("abcdé .\n") for _ in range(n)) for n in (5000, 90, 3000, 0)])
    whole = [sorted(x.tolist()) for x in quality.features(texts)]
    monkeypatch.setattr(quality, "BLOCK_BYTES", 64)
    monkeypatch.setattr(quality, "row_ranges", lambda at: words.row_ranges(at, 64))
    assert [sorted(x.tolist()) for x in quality.features(texts)] == whole


def test_repeated_ids_do_not_make_the_sample_larger(spark):
    rows = [(1, f"good text {i}") for i in range(300)] + [(2, "bad text"), (3, "good words"), (2, "bad text")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    weights = quality.model(documents, labels)
    again = quality.model(documents.orderBy(F.desc("text")), labels)
    assert weights.tobytes() == again.tobytes()
