"""Decontamination against all windows of all sizes, on given and made texts."""

import re
from collections import Counter

import pyarrow.parquet as pq

from signalgrid.llm import decontaminate
from signalgrid.llm.decontaminate import contaminated

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def grams(w, k):
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(docs, items):
    out = {}
    for item_id, text in items:
        iw = words(text)
        if not iw:
            continue
        k = min(5, len(iw))
        wanted = grams(iw, k)
        for doc_id, body in docs:
            dw = words(body)
            width = min(len(iw), len(dw))
            if width < k or not any(g in wanted for g in grams(dw, k)):
                continue
            for s in range(len(dw) - width + 1):
                own = grams(dw[s:s + width], k)
                common = sum((own & wanted).values())
                share = common / (sum(own.values()) + sum(wanted.values()) - common)
                if share >= 0.75 and share > out.get((doc_id, item_id), (0,))[0]:
                    out[doc_id, item_id] = (share, s, width)
    return out


def got(spark, docs, items):
    rows = contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                        spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    return {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in rows}


def test_given_tables(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()]
    wanted = brute(docs, items)
    assert wanted and got(spark, docs, items) == wanted


def test_edits_cases_and_odd_rows(spark):
    base = [f"w{i}x" for i in range(40)]
    items = [(1, " ".join(base)), (2, "one two three"), (3, None), (4, "..!"), (5, "same " * 20), (1, " ".join(base))]
    edit = base[:20] + ["new"] + base[20:]
    swap = base[:10] + ["zz"] + base[11:]
    docs = [(10, "pre fix " * 30 + " ".join(base).upper() + " tail"), (11, ", ".join(edit)), (12, " ".join(swap)),
            (13, " ".join(base[:20])), (14, " ".join(base[:35])), (15, "and ONE, two; three."), (16, None), (17, ""),
            (18, "same " * 400), (None, " ".join(base)), (10, "pre fix " * 30 + " ".join(base).upper() + " tail"),
            (19, " ".join(base[20:] + base[:20]))]
    wanted = brute(docs, items)
    assert {k[0] for k in wanted} == {10, 11, 12, 14, 15, 18, 19, None}
    assert got(spark, docs, items) == wanted


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b c")]) == {}
    assert got(spark, [(1, "a b c")], []) == {}


def test_texts_are_cut_once_and_kept_as_far_as_windows_reach(spark, monkeypatch):
    item = [f"w{i}x" for i in range(40)]
    rest = [f"r{i}" for i in range(3000)]
    edit = item[:30] + ["zz"] + item[31:]
    docs = [(1, " ".join(rest + item + rest)), (2, " ".join(item + rest + edit)), (3, " ".join(rest)), (4, " ".join(rest + edit)),
            (4, " ".join(rest + edit)), (None, " ".join(edit + rest)), (5, None), (5, " ".join(rest + item))]
    items = [(7, " ".join(item)), (8, "a b c")]
    kept, plans = {}, []

    def noted(df, purpose, store=decontaminate.stored):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        kept[purpose] = store(df, purpose)
        return kept[purpose]

    monkeypatch.setattr(decontaminate, "stored", noted)
    wanted = brute(docs, items)
    assert len(wanted) == 5 and got(spark, docs, items) == wanted
    sizes = sorted(len(r.words) for r in kept["texts"].collect())
    assert len(sizes) == 5 and sizes[-2] < 80 and sizes[-1] == 3080
    cuts = [(len(re.findall(r"regexp_extract_all\(|split\(", p)), p.count("LogicalRDD")) for p in plans]
    assert sum(n for n, _ in cuts) == 4 and all(n <= scans for n, scans in cuts)  # the items, a scan for each of two kinds, the texts
