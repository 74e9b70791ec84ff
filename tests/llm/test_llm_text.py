"""Quality rules, line dedup, substring dedup, Jaccard join, decontamination."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from fleetlife.llm import components, decontaminate, jaccard, lines, quality, queries, substrings

PATH = "/root/testdata/sf0.001"
RNG = random.Random(5)
WORDS = ["".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(2, 8))) for _ in range(4000)]


def sentence(n, rng=RNG):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


def prose(sentences, rng=RNG):
    return " ".join(sentence(rng.randint(4, 14), rng) for _ in range(sentences))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    got = queries.QUERIES[name](spark, PATH)
    cursor = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, got.select(*names).collect())) == sorted(
        "Row(" + ", ".join(f"{n}={v!r}" for n, v in zip(names, r)) + ")" for r in cursor.fetchall())


def test_quality_keeps_prose_and_drops_menus(docs):
    clean = "\n".join(prose(3) for _ in range(4))
    menu = "\n".join("Home | News | Shop | Contact" for _ in range(12))
    got = {r.doc_id: r.quality for r in quality.assess(docs({1: clean, 2: menu, 3: clean + "\nAll rights reserved.", 4: None})).collect()}
    assert got[1].kept and got[1].clean_text == clean and got[1].n_removed_lines == 0
    assert not got[2].kept and got[2].n_removed_lines == 12
    assert got[3].kept and got[3].clean_text == clean
    assert got[4].n_words == 0 and got[4].base_failed and not got[4].kept
    assert [r.doc_id for r in quality.clean(docs({1: clean, 2: menu})).collect()] == [1]


def test_quality_counts_repeated_words(docs):
    eight = "a b c d e f g h"
    got = quality.assess(docs({1: f"{eight} x {eight}", 2: "w " * 9, 3: "w " * 8})).collect()
    assert {r.doc_id: r.quality.n_repeat_words for r in got} == {1: 16, 2: 9, 3: 0}


def test_quality_of_odd_rows(odd, none):
    assert quality.assess(odd).count() == odd.count() and quality.assess(none).count() == 0
    assert quality.clean(odd).columns == odd.columns


def test_quality_cuts_a_text_into_words_once(docs):
    rows = docs({1: "a b\n\n \t\nc\x0bd | e. \nMenu | b | c\n", 2: None})
    got = {r.doc_id: r.quality for r in quality.assess(rows).collect()}
    assert (got[1].n_words, got[1].word_chars, got[1].n_removed_lines, got[1].clean_text) == (11, 15, 3, "\n \t\n")
    assert (got[2].n_words, got[2].word_chars, got[2].clean_text) == (0, 0, "")
    plan = quality.assess(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\x20\\x09-\\x0D") == 1


def _left(texts, gone):
    out = {}
    for i, text in texts.items():
        kept = "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone)
        if kept.split() or not any(d == i for d, _ in gone):
            out[i] = kept
    return out


def _repeated_runs(texts, need=10):
    """Brute force: lines in any run of ``need`` words that is there at an earlier place too."""
    kept = {i: [(k, x) for k, x in enumerate((texts[i] or "").split("\n")) if x.split()] for i in texts}
    first, gone = {}, set()
    for i in sorted(texts):
        for s in range(len(kept[i])):
            for e in range(s + 1, len(kept[i]) + 1):
                run = tuple(x for _, x in kept[i][s:e])
                if len(" ".join(run).split()) >= need and first.setdefault(run, (i, s)) != (i, s):
                    gone |= {(i, k) for k, _ in kept[i][s:e]}
    return gone


def test_line_runs_as_by_brute_force(docs):
    rng = random.Random(2)
    pool = [" ".join(rng.choices(WORDS[:9], k=k)) for k in (1, 2, 4, 5, 7, 11, 30)]
    texts = {i: "\n".join(rng.choice(pool + [f"only here {i}", "  ", ""]) for _ in range(rng.randint(0, 14))) for i in range(60)}
    run = "\n".join((sentence(68), sentence(4)))
    texts |= {60: "again and again\n" * 30, 61: run, 62: f"{sentence(3)}\n{run}\n{sentence(3)}"}
    frame = docs(texts)
    found = lines.repeats(frame)
    got = {(r.doc_id, k) for r in found.collect() for k in r.lines}
    assert got == _repeated_runs(texts) and {(62, 1), (62, 2)} <= got
    assert {r.doc_id: r.text for r in lines.remove(frame, found).collect()} == _left(texts, got)


def test_suffix_ranks_follow_the_order_of_suffixes(docs):
    rows = lines.suffix_ranks(docs({1: "a\nb\na\nb\na", 2: "b\na\nb"}), 4).collect()
    names = {r["rank_0"] for r in rows}
    text = {1: "ababa", 2: "bab"}
    rank = {"a": min(names, key=lambda n: [text[r.doc_id][r.place] for r in rows if r["rank_0"] == n] != ["a"] * 4)}
    code = lambda s: [0 if c == "a" else 1 for c in s]
    low = 0 if rank["a"] == min(names) else 1
    order = sorted(rows, key=lambda r: [c ^ low for c in code(text[r.doc_id][r.place:r.place + 4])])
    ranks = [r["rank_2"] for r in order]
    assert ranks == sorted(ranks)


def test_lines_of_odd_rows(odd, none):
    assert lines.repeats(none).count() == 0
    left = lines.remove(odd, lines.repeats(odd))
    assert left.columns == odd.columns and left.count() == odd.count()  # equal rows are one document


def test_spans_as_by_brute_force(docs):
    passage = " ".join(sentence(n) for n in (9, 12, 20, 15))
    texts = {i: prose(12) for i in range(30)}
    for i in (3, 7, 19):
        texts[i] = prose(2) + " " + passage + " " + prose(2)
    texts[29] = texts[28]
    found = substrings.repeats(docs(texts))
    got = {r.doc_id: r for r in found.collect()}
    assert set(got) == {7, 19, 29} and got[7].first_doc_ids == [3] and got[29].first_doc_ids == [28]
    left = {r.doc_id: r.text for r in substrings.remove(docs(texts), found).collect()}
    assert left[29].strip() == "" and passage in left[3] and all(left[i] == texts[i] for i in range(28) if i not in (7, 19))
    for i in (7, 19):
        assert passage[:60] not in left[i] and left[i].startswith(texts[i][:20])


def test_long_sentences_are_spans(docs):
    long = sentence(55)
    assert {r.doc_id for r in substrings.repeats(docs({1: prose(3) + " " + long, 2: long + "\n" + prose(3)})).collect()} == {2}


def test_repeated_sentences_go_to_the_end_of_the_run(docs):
    rng = random.Random(3)
    pool = [sentence(n, rng) for n in (3, 5, 9, 12, 12, 19, 45)]
    texts = {i: " ".join(rng.choice(pool + [sentence(4, rng)]) for _ in range(rng.randint(0, 9))) for i in range(40)}
    for i, sizes in ((50, (12, 12, 5)), (60, (45, 12)), (70, (5, 12, 45, 3, 2))):
        texts[i] = " ".join(sentence(n, rng) for n in sizes)
        texts[i + 1] = f"{sentence(8, rng)} {texts[i]} {sentence(8, rng)}"
    first, want = {}, set()
    for i in sorted(texts):
        parts = [x.lower().split() for x in substrings.sentences(texts[i])]
        for s in range(len(parts)):
            for e in range(s + 1, len(parts) + 1):
                n = sum(map(len, parts[s:e]))
                if n >= 40 or (n >= 20 and e - s >= 2):
                    if first.setdefault(str(parts[s:e]), (i, s)) != (i, s):
                        want |= {(i, k) for k in range(s, e)}
    found = substrings.repeats(docs(texts))
    assert {(r.doc_id, k) for r in found.collect() for x in r.spans for k in range(x["first"], x["last"] + 1)} == want
    assert {(51, 3), (61, 2), (71, 5)} <= want


def test_sentences_rebuild_the_text():
    for text in ("", "A. B!\n\nC? d", "no end", "é. ü\n", "a.b. c"):
        assert b"".join(substrings.sentences(text)).decode() == text


def test_spans_of_odd_rows(odd, none):
    found = substrings.repeats(odd)
    assert found.where("doc_id = 5").count() == 0  # equal rows are one document
    assert substrings.repeats(none).count() == 0
    assert substrings.remove(odd, found).columns == odd.columns


def _near(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


@pytest.mark.parametrize("size,at_least", [(4, 85), (5, 80)])
def test_jaccard_as_by_brute_force(docs, monkeypatch, size, at_least):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(size)
    texts = [None, "", "a", "a", "A b", "a b c d", " a b\tc d"]
    for _ in range(6):
        whole = " ".join(rng.choices(WORDS, k=rng.randint(30, 160)))
        texts += [_near(rng, whole, rng.randint(0, 4)) for _ in range(9)] + [whole, whole + " " + sentence(4, rng)]
    texts += [prose(8, rng) for _ in range(20)]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    n = len(texts)
    linked = {(a, b) for a in range(n) for b in range(n) if a != b and sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= at_least * len(sets[a] | sets[b])}
    root = list(range(n))
    for _ in range(n):
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: r for r in jaccard.join(docs(texts), size, at_least).collect()}
    assert [got[i].n_shingles for i in range(n)] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(n)] == root
    assert [got[i].n_links for i in range(n)] == [sum((i, j) in linked for j in range(n)) for i in range(n)]


def test_overlaps_are_exact():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40)).astype("<u8") for _ in range(12)] + [np.array([99], "<u8")]
    assert (jaccard.overlaps(sets) == [[len(set(a) & set(b)) for b in sets] for a in sets]).all()


def test_jaccard_of_odd_rows(odd, none):
    got = jaccard.join(odd).collect()
    assert len(got) == odd.count() and sum(r.doc_id == 5 and r.n_links == 1 for r in got) == 2
    assert jaccard.join(none).count() == 0


def test_components_as_by_union(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500, i) for i in range(501, 560)]
    edges += [(600 + i, 601 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def _index(items, threshold=0.6):
    count = {}
    for t in items:
        for w in set(decontaminate.words(t)):
            count[w] = count.get(w, 0) + 1
    idf = {w: float(np.log(1 + (len(items) - c + 0.5) / (c + 0.5))) for w, c in count.items()}
    mean = float(np.mean([len(decontaminate.words(t)) for t in items]))
    return decontaminate.Index(pd.DataFrame({"item_id": range(len(items)), "text": items}), idf, mean, threshold)


def test_wand_as_by_brute_force():
    items = [sentence(RNG.randint(5, 30)) + " " + sentence(6) for _ in range(120)]
    index = _index(items, 0.3)
    for k in range(200):
        query = set(decontaminate.words(items[k % 120])[: RNG.randrange(30)]) | {w.encode() for w in RNG.choices(WORDS, k=30)}
        score = {}
        for w in query & index.postings.keys():
            for p, v in zip(*index.postings[w][:2]):
                score[p] = score.get(p, 0) + v
        assert sorted(index.search(query)) == sorted((p, v) for p, v in score.items() if v >= index.least)


def test_leaks_are_found_in_any_place(spark, docs):
    items = [sentence(12) + " " + sentence(9) for _ in range(40)] + [sentence(40) + "\n" + sentence(3), "", None]
    frame = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts, want = {}, set()
    for i in range(60):
        texts[i] = prose(RNG.randint(2, 30))
        if i % 3 == 0:
            k = i % 41
            texts[i] = prose(RNG.randint(1, 15)) + " " + items[k].upper() + " " + prose(RNG.randint(1, 9))
            want.add((i, k))
    texts[60] = prose(3) + " " + " ".join(reversed(items[5].split()))  # the words, but not the passage
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(texts), frame).collect()}
    assert got == want
    assert {r.doc_id for r in decontaminate.clean(docs(texts), frame).collect()} == set(texts) - {i for i, _ in want}


def test_many_items_take_several_passes(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_PER_INDEX", 7)
    items = spark.createDataFrame([(i, sentence(20)) for i in range(30)], "item_id long, text string")
    said = {r.item_id: r.text for r in items.collect()}
    got = decontaminate.leaks(docs({i: prose(4) + " " + t for i, t in said.items()}), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in said}


def test_decontamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, sentence(20))], "item_id long, text string")
    assert decontaminate.leaks(odd, items).count() == 0 and decontaminate.leaks(none, items).count() == 0
    assert decontaminate.clean(odd, items).count() == odd.count()
    assert decontaminate.leaks(odd, items.where("false")).count() == 0
