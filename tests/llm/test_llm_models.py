"""Licence scan, packing, URL filters, chat formatting, language model, pipeline."""

import collections
import hashlib
import itertools
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlife.llm import chat, licences, lm, packing, queries, urls
from fleetlife.session import work_dir

PATH = "/root/testdata/sf0.001"


def test_licences_are_found_and_prose_is_not(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    made = licences.fit(docs, 1500)
    got = {(r.doc_id, r.paragraph): r.family for r in licences.scan(docs, made).collect()}
    want = {(r.doc_id, i) for r in rows for i, x in licences.windows(r.text) if re.search("licen[sc]|rights reserved", x, re.I)}
    assert want and set(got) == want
    plain = spark.createDataFrame([(1, "Licensed under the MIT License.\n\nThe train left on time."), (2, None), (2, ""),
                                   (None, "All rights reserved.")], "doc_id long, text string")
    found = licences.scan(plain, made).collect()
    assert sorted((str(r.doc_id), r.paragraph, r.family) for r in found) == [("1", 0, "MIT"), ("None", 0, "proprietary")]
    # The same rows as by looking at each window alone.
    every = {}
    for r in rows:
        for i, x in licences.windows(r.text):
            if said := made.judge(x):
                every.setdefault((r.doc_id, i), set()).add(said[0])
    assert {k: {v} for k, v in got.items()} == {k: (v - {"unknown"} or v) for k, v in every.items()}


def test_wrapped_and_buried_notices(spark, odd):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "text")
    made = licences.fit(docs, 1500)
    prose = " ".join(r.text or "" for r in docs.limit(40).collect() if not licences._CUE.search(r.text or "")).split()
    for family, wording in licences.TEMPLATES:
        words = wording.split()
        if len(words) >= 8:
            wrapped = "".join(w + ("\n * " if k % 7 == 6 else " ") for k, w in enumerate(words))
            assert [x[1] for x in made.families(wrapped)] == [family]
        at = rng.randrange(len(prose) - 300)
        assert family in [x[1] for x in made.families(" ".join([*prose[at:at + 150], *words, *prose[at + 150:at + 300]]))]
    assert not [x for m in licences.MENTIONS for x in made.families(m) if x[1] != "unknown"]
    more = odd.unionByName(spark.createDataFrame([(8, "Licensed under the MIT License.", "MIT", 1, "h")] * 2, odd.schema))
    assert [(r.doc_id, r.family) for r in licences.scan(more, made).collect()] == [(8, "MIT")] * 2


def test_windows_hold_every_word():
    text = " ".join(map(str, range(1000))) + "\n \t\n" + "x\ny" + "\n\n\n" + " " + "\n\nz"
    found = list(licences.windows(text))
    assert [w for i, w in found if i] == ["x y", "z"] and {w for i, x in found for w in x.split() if not i} == set(map(str, range(1000)))
    runs = [" ".join(map(str, range(k, k + licences._LONGEST_TEMPLATE))) for k in range(1000 - licences._LONGEST_TEMPLATE)]
    assert all(any(f" {run} " in f" {x} " for i, x in found if not i) for run in runs)


def test_sample_is_of_distinct_windows(spark, docs):
    frame = docs(["the same line in every text\n\n" + f"only {i} here and the licence of {i}" for i in range(400)])
    sample = licences._sample(frame, 100)
    assert len({t for t, _ in sample}) == len(sample) and sum(c for _, c in sample) == 25


def test_held_out_accuracy_and_unknown(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "text")
    made = licences.fit(docs, 1500)
    rows = licences.training_rows(docs, 1500).where("held_out").collect()
    right = sum(made.labels[int(made.scores(r.grams).argmax())] == r.label for r in rows)
    assert right / len(rows) > 0.95
    said = made.judge("Licensed under the terms that the owner keeps in the drawer of the kitchen.")
    assert said is None or said[0] == licences.UNKNOWN


def test_no_documents_for_licences(none):
    assert licences.scan(none, licences.fit(none)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_cached_tokens_are_the_tokenizers(tokenizer):
    cache, rng = packing.WordCache(None, words=50), random.Random(2)
    letters = "aZéÉüßñÇŒłĞğİıÿ'.,!?-<|>_~#1²ª× \t\n\x0b ́ΣςА中\x1c"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)] + ["it's <|endoftext|>x", "", " "]
    assert all(list(cache.ids(t)) == tokenizer.encode(t, add_special_tokens=False).ids for t in texts)


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_bins_hold_every_constraint(score):
    rng = np.random.default_rng(1)
    size = np.sort(rng.integers(1, 401, 3000))[::-1]
    need = np.stack([size, np.ones_like(size), size * size], axis=1).astype(float)
    capacity = np.array([500, 6, 160_000.0])
    bins, offsets = packing.best_fit(need, capacity, np.array([1, 0.3, 0.3]), score)
    load = np.stack([np.bincount(bins, need[:, d]) for d in range(3)], axis=1)
    assert (load <= capacity).all() and load[:, 0].sum() == size.sum()
    for b in range(0, bins.max() + 1, 7):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offsets[at])]
        assert (offsets[at] == np.concatenate([[0], np.cumsum(size[at])[:-1]])).all()
    left, weights = [], np.array([1, 0.3, 0.3])  # every choice again, by looking at all bins
    for item, b in zip(need, bins):
        fits = [k for k, r in enumerate(left) if (r >= item).all()]
        if b == len(left):
            assert not fits
            left.append(capacity.copy())
        else:
            value = {k: (weights * ((left[k] - item) / capacity) ** 2).sum() if score == "norm"
                     else -(weights * item * left[k] / capacity ** 2).sum() for k in fits}
            assert value[b] <= min(value.values()) + 1e-12
        left[b] = left[b] - item
    tokens_only, _ = packing.best_fit(need[:, :1], capacity[:1], np.ones(1))
    assert tokens_only.max() + 1 <= math.ceil(size.sum() / 500) * 1.01 + 1


def test_pack_round_trip(spark, odd, none, tokenizer):
    packed = packing.pack(odd, with_ids=True)
    rows = packed.collect()
    whole = collections.defaultdict(list)
    for r in rows:
        assert r.length <= 2048 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        whole[r.doc_id].append(r)
    for r in odd.where("doc_id <> 5").collect():
        ids = [t for p in sorted(whole[r.doc_id], key=lambda p: p.piece) for t in p.ids]
        assert ids == tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
    assert len(whole[5]) == 2 and len(whole[None]) == 1
    for r in packing.sequences(packed).collect():
        assert len(r.ids) == r.n_tokens <= 2048
    assert packing.pack(none).count() == 0


def test_limits_on_documents_and_attention(docs):
    frame = docs([f"word {'more ' * (i % 40)}" for i in range(300)])
    rows = packing.pack(frame, max_tokens=64, max_documents=3, max_attention=2000, weights=(1, 1, 1)).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r.length)
    assert all(sum(v) <= 64 and len(v) <= 3 and sum(x * x for x in v) <= 2000 for v in by.values())


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def test_fixed_rules(spark):
    given = spark.createDataFrame(RULES, "host string, path string, verdict string")
    want = {
        "http://A.example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.net/fr/": ("example.net", "/fr/", "net/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://x.example.com/de/a": ("x.example.com", "/de/a", "example.com/de/", "block"),
        "http://a.org/fr/?q": ("a.org", "/fr/", "org/fr/", "allow"), "http://net?a=b": ("net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow")}
    pages = spark.createDataFrame([(u, "v", "w") for u in want] * 2, "url string, rule string, verdict string")
    none = spark.createDataFrame([], "rule string, tokens array<string>, confidence double, support double")
    got = urls.judge(pages, given, none).collect()
    assert len(got) == 2 * len(want) and all((r.host, r.path, r.rule, r.verdict) == want[r.url] for r in got)


def test_mined_rules_as_by_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        host, lang, key = rng.choice(["spam", "shop", "news", "blog"]), rng.choice(["en", "de", "fr"]), rng.choice(["a", "b"])
        bad = (host == "spam" and key == "a") or rng.random() < 0.05
        rows.append((f"http://{host}.example.com/{lang}/{i % 50}?{key}=1", bad if i % 5 else None))
    pages = spark.createDataFrame(rows, "url string, bad boolean")
    mined = urls.mine(pages)
    rules = mined.collect()
    bags = {r.url: set(r.t) for r in pages.select("url", urls.tokens_of(F.col("url")).alias("t")).collect()}
    known = [(u, b) for u, b in rows if b is not None]
    base = sum(b for _, b in known) / len(known)

    def facts(tokens):
        of = [b for u, b in known if tokens <= bags[u]]
        p, n, z = sum(of) / len(of), len(of), urls.SIGMAS
        low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        return p, sum(of) >= urls.MIN_ROWS and p >= urls.MIN_CONFIDENCE and low > base

    for r in rules:
        p, good = facts(set(r.tokens))
        assert good and abs(p - r.confidence) < 1e-9
    # All that qualifies is said by a rule that holds wherever it does and is as confident.
    seen = [frozenset(u for u, _ in known if set(r.tokens) <= bags[u]) for r in rules]
    sets = {frozenset(x) for u, b in known if b for k in range(1, 6) for x in itertools.combinations(sorted(bags[u] - {"scheme=http"}), k)}
    checked = 0
    for x in sets:
        of = {u for u, _ in known if x <= bags[u]}
        if len(of) >= urls.MIN_ROWS and facts(x)[1]:
            checked += 1
            assert any(of <= where and r.confidence >= facts(x)[0] for r, where in zip(rules, seen))
    assert checked > 20
    want = {}
    for u, bag in bags.items():
        fit = [(-r.confidence, -r.support, r.rule) for r in rules if set(r.tokens) <= bag]
        if fit:
            want[u] = min(fit)[2]
    assert {r.url: r.matched_rule for r in urls.match(pages, mined).collect()} == want
    assert urls.mine(pages.where("bad IS NULL")).count() == 0
    assert urls.mine(pages.where("bad")).count() == 0  # nothing is above a share of one


def test_rules_of_five_tokens_are_found(spark):
    every = list(itertools.product("ab", repeat=5)) * 40
    pages = spark.createDataFrame([("http://h.org/" + "/".join(p) + f"/{i}", p == ("a",) * 5) for i, p in enumerate(every)],
                                  "url string, bad boolean")
    assert [r.rule for r in urls.mine(pages).collect()] == [" & ".join(f"path{i}=a" for i in range(5))]


def test_no_pages_and_very_long_urls(spark):
    given = spark.createDataFrame(RULES, "host string, path string, verdict string")
    long = "http://x.example.com/de/" + "a/" * 20_000 + "?" + "k&" * 20_000
    pages = spark.createDataFrame([(1, long), (2, long)], "page_id long, url string")
    rules = urls.mine(pages.withColumn("bad", F.lit(True)))
    assert {(r.page_id, r.verdict) for r in urls.judge(pages, given, rules).collect()} == {(1, "block"), (2, "block")}
    assert urls.judge(pages.where("false"), given, rules).count() == 0


def _turns(spark, convs):
    rows = [(c, i, r, t, "x") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, windows string")


def test_chat_round_trip_and_windows(spark):
    rng = random.Random(6)
    said = lambda n: " ".join(rng.choices(["yes", "<|im_end|>", "<\\|", "<", "\\", "a|b", "\n", "<|im_start|>assistant\n"], k=n))
    convs = {c: ([("system", said(9))] if c % 2 else []) + [(("user", "assistant")[i % 2], said(rng.randint(0, 60)))
             for i in range(rng.randint(1, 30))] for c in range(40)}
    convs[100] = [("assistant", None), (None, "x"), ("as\nsis\\tant", "y<")]
    convs[101] = [("system", "only")]
    turns = _turns(spark, convs)
    formatted = chat.format_conversations(turns, budget=300, history=80)
    plain_tokens = lambda x: [t for part in re.findall(r"(?s)<\|im_start\|>.*?<\|im_end\|>\n", x)
                              for t in counter.encode(part, add_special_tokens=False).ids]
    counter = chat._tokenizer(None)
    by = collections.defaultdict(list)
    for r in formatted.orderBy("conv_id", "window").collect():
        by[r.conv_id].append(r)
    assert set(by) == set(convs)
    for conv, made in by.items():
        roles, texts = [x[0] or "" for x in convs[conv]], [x[1] or "" for x in convs[conv]]
        n_system, at, loss = int(roles[0] == "system"), 0, []
        for k, w in enumerate(made):
            assert w.window == k and w.n_new == len(chat.read_turns(w.text)) - w.n_system - w.n_history
            assert w.n_tokens == len(plain_tokens(w.text))
            got = chat.read_turns(w.text)
            repeated = (n_system if k else 0) + w.n_history
            assert w.n_tokens <= 300 or w.over_budget
            if w.over_budget:
                assert len(got) - (n_system if k else 0) - w.n_history == 1 or n_system and not k
            assert got[repeated:] == list(zip(roles, texts))[at:at + len(got) - repeated]
            assert got[:n_system] == list(zip(roles, texts))[:n_system]
            at += len(got) - repeated
            loss += [chat.unescape(w.text[s.start:s.end]) for s in w.loss]
        assert at == len(roles) and loss == [t for r_, t in zip(roles, texts) if r_ == "assistant"]
    for r in chat.digests(formatted).collect():
        plain = "".join(f"{a or ''}\n{b or ''}\n" for a, b in convs[r.conv_id])
        assert r.turns_sha256 == hashlib.sha256(plain.encode()).hexdigest() and r.n_turns == len(convs[r.conv_id])


def test_chat_edge_rows(spark):
    turns = spark.createDataFrame([(None, 1, "user", "a"), (None, None, "user", "b"), (2**60 + 1, 0, "user", "c"), (2**60 + 1, 0, "user", "c")],
                                  "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.n_turns for r in chat.digests(chat.format_conversations(turns)).collect()}
    assert got == {None: 2, 2**60 + 1: 2}
    assert chat.digests(chat.format_conversations(turns.where("false"))).count() == 0


def test_windows_as_by_whole_lists():
    """Each window takes what fits: checked against the costs of the whole conversation."""
    rng = random.Random(9)
    for _ in range(300):
        costs = [rng.choice([1, 5, 20, 60, 130]) for _ in range(rng.randint(1, 40))]
        n_system, made = rng.randint(0, 2), chat.Windows(100, 30)
        roles = ["system"] * n_system + ["user"] * (len(costs) - n_system)
        found = [w for r, c in zip(roles, costs) if (w := made.push(r, "", c))]
        found += [w] if (w := made.last()) else []
        base, at, costs = sum(costs[:n_system]), 0, costs[n_system:]
        for k, w in enumerate(found):
            back = at
            while k and back and sum(costs[back - 1:at]) <= 30:
                back -= 1
            while back < at and base + sum(costs[back:at + 1]) > 100:
                back += 1
            end = min(at + 1, len(costs))
            while end < len(costs) and base + sum(costs[back:end + 1]) <= 100:
                end += 1
            assert (w["n_history"], w["n_new"], w["n_tokens"]) == (at - back, end - at, base + sum(costs[back:end]))
            at = end
        assert at == len(costs) and len(found) >= 1


def test_very_long_conversation(spark):
    turns = spark.range(30_000).selectExpr("NULL AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role",
                                           "concat('turn ', id, ' of many') AS text").withColumn("conv_id", F.col("conv_id").cast("long"))
    row, = chat.digests(chat.format_conversations(turns)).collect()
    said = [f"turn {i} of many" for i in range(30_000)]
    want = "".join(f"{('user', 'assistant')[i % 2]}\n{x}\n" for i, x in enumerate(said))
    assert row.n_turns == 30_000 and row.turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256("".join(said[1::2]).encode()).hexdigest()


def test_cached_costs_are_the_tokenizers():
    costs, rng = chat.Costs(words=40), random.Random(5)
    letters = "abÉß中 '  \t\n\x1c\xa0.,12<|>\\´s"
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 30)))
        assert costs.of(text) == len(costs.tokenizer.encode(text, add_special_tokens=False).ids)


def test_escape_is_reversible():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choices("<|\\a\n", k=rng.randint(0, 9)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_seating_has_the_expected_tables():
    rng = np.random.default_rng(0)
    for c, w in ((1, 0.5), (2, 0.5), (40, 2.0), (5000, 3.0)):
        got = lm.seated(np.full(2000 if c < 100 else 200, c), np.full(2000 if c < 100 else 200, w), 0.5, rng)
        want = np.ones(400)
        for k in range(1, c):
            want += rng.random(400) < w / (w + k - 0.5 * want)
        assert got.min() >= 1 and got.max() <= c and abs(got.mean() - want.mean()) <= 0.15 + 0.05 * want.mean()


def test_base_score_and_probabilities(spark, odd):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "text").unionByName(
        odd.select("doc_id", "text").where("doc_id <> 6"))
    rows = docs.collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = collections.Counter(w for r in rows if not held(r.doc_id) for w in lm.tokens(r.text))
    n, v = sum(count.values()), len(count)
    def base(text):
        t = lm.tokens(text)
        return len(t), sum(count[w] > 0 for w in t), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 5)
    want = sorted(((str(r.doc_id), held(r.doc_id), *base(r.text)) for r in rows))
    got = lm.score(docs, 40)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got.collect()) == want
    both = {r.held_out: r for r in lm.perplexity(got).collect()}
    assert both[True].perplexity < both[True].base_perplexity and both[False].perplexity < both[True].perplexity


def test_predictive_probabilities_sum_to_one(docs):
    frame = docs({0: "a b a b c a", 1: "b a c d a b", 3: "c c a d"})
    frequent = lm.Frequent(np.empty(0, "<u8"), np.empty(0, "int64"))
    rows = lm.read(frame, frequent, 1)
    chunk = F.struct("batch", "words", "lengths", "contexts", "docs", "hot_words", "hot_contexts", "hot_counts")
    found = lm.types(rows.where("kind = 1").groupBy("bucket").agg(F.collect_list(chunk).alias("chunks")), 2)
    row = found.collect()[0].asDict()
    row = {k: bytes(x) if isinstance(x, bytearray) else x for k, x in row.items()}
    words, history = row["n_words"], lm.sweeps(found, 2, row["n_words"], lm.BURN_IN + lm.SAMPLES)
    customers = np.bincount(np.frombuffer(row["keys"], "<i8") % 2, np.frombuffer(row["counts"], "<u4"), 2)
    model = lm.Model(row, 2, words, history, customers)
    for context in (0, 1):
        assert abs(model.probability(np.arange(words + 1), np.full(words + 1, context)).sum() - 1) < 1e-9


def test_rare_contexts_are_told_apart(docs):
    learned, asked = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2], [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    texts = {i: f"x{i % 20} y{i % 20}" for i in learned} | {i: f"x{k % 20} y{(k + k % 2) % 20}" for k, i in enumerate(asked)}
    got = {r.doc_id: r.score for r in lm.score(docs(texts), 1).collect()}
    assert min(got[i] for i in asked[::2]) > max(got[i] for i in asked[1::2]) + 0.5


def test_customers_and_tables_of_each_context_add_up(docs):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choices("abcdefghij", [30, 20, 9, 8, 7, 6, 5, 4, 3, 2], k=30)) for i in range(40)}
    frame = docs(texts).coalesce(1)
    words = sorted(lm.hashed([b"a", b"b"]))
    frequent, buckets = lm.Frequent(np.array(words, "<u8"), np.ones(2, "int64")), 3
    asked = lm.grouped(lm.read(frame.where(~lm.held_out(F.col("doc_id"))), frequent, buckets))
    found = lm.with_dishes(lm.types(asked, 4), buckets)
    history = lm.sweeps(found, 4, 11, lm.BURN_IN + lm.SAMPLES)
    told = lm.answers(asked, found, 4, 11, history, buckets).orderBy("bucket").collect()
    wide = lambda c, n: np.concatenate([lm.unpacked(r[c], "<u4").reshape(n, -1) for r in told], axis=1)
    facts, own, near = wide("words", 13), wide("own", 2), wide("near", 2)
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    h = [lm.hashed(lm.tokens(t)) for t in train]
    rare = np.unique(np.concatenate(h))
    rare = rare[~np.isin(rare, words)]
    pairs = collections.Counter((w, c) for t in h for c, w in zip(t, t[1:]))
    starts = collections.Counter(t[0] for t in h)
    count, tables = collections.Counter(), collections.Counter()
    mine = [(w, c) for w in rare for c in sorted(words) + [c for c in rare if pairs[w, c]] + ["start"]
            if (starts[w] if c == "start" else pairs[w, c])]
    mine = sorted(mine, key=lambda p: (p[0], 2 if isinstance(p[1], str) else int(p[1] not in words), 0 if isinstance(p[1], str) else p[1]))
    theirs = [(w, c) for c in rare for w in sorted(words) if pairs[w, c]]
    assert own.shape[1] == len(mine) and near.shape[1] == len(theirs)
    for (w, c), n, t in [*zip(mine, *own), *zip(theirs, *near)]:
        assert n == (starts[w] if c == "start" else pairs[w, c]) and lm.SAMPLES <= t <= lm.SAMPLES * n
        if c in rare:
            count[c] += int(n)
            tables[c] += int(t)
    told = rare != lm.hashed([lm.END])[0]  # nothing comes after the end
    assert [count[c] for c in rare[told]] == list(facts[0, told]) and [tables[c] for c in rare[told]] == list(facts[9:].sum(axis=0)[told])


def test_coded_tokens_are_those_of_each_text():
    rng = random.Random(3)
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", "A  b\u00a0c\x1cD ", "\u00c4\u0130x \x85y\x00Z", " a", "a ", "a\n\nA"] + [
        "".join(rng.choices(" \t\n\x0b\x0c\r\x1c\x1f\x85\u00a0\u2003aAbZ\u00e9\u00c9\x00", k=rng.randint(0, 12))) for _ in range(500)]
    for some in (texts, texts[:1], texts[1:3], []):
        code, n, words = lm.coded(some)
        want = [lm.tokens(t) for t in some]
        assert [words[i] for i in code] == [w for t in want for w in t] and list(n) == [len(t) for t in want]
        assert len(set(words)) == len(words)


def test_places_of_numbers_in_order():
    rng = np.random.default_rng(1)
    for top in (1, 50, 1 << 40, (1 << 62) + 1):  # the last needs more than 63 bits beside its place
        key = rng.integers(0, top, 1000)
        got, place = lm.in_order(key)
        assert np.array_equal(place, np.argsort(key, kind="stable")) and np.array_equal(got, np.sort(key))
        for got, want in zip(lm.different(key), np.unique(key, return_inverse=True)):
            assert np.array_equal(got, want)
    assert [len(x) for x in lm.different(np.empty(0, "int64"))] == [0, 0]


def test_packed_numbers_are_short_and_read_back():
    rng = np.random.default_rng(1)
    small = rng.geometric(0.4, 20000)
    for kind in ("<u2", "<u4"):
        for a in (small.astype(kind), small.astype(kind).reshape(4, -1), np.empty(0, kind)):
            assert np.array_equal(lm.unpacked(lm.packed(a), kind), a.ravel())
    assert len(lm.packed(small.astype("<u4"))) < 8000  # one number after the other took 12.7 kB


def test_dishes_are_put_in_order_once_for_all_sweeps(monkeypatch):
    customers, fresh = np.random.default_rng(5).geometric(0.01, 3000), np.full(3000, 0.7)
    want = lm.seated(customers, fresh, 0.5, np.random.default_rng(2))
    assert np.array_equal(lm.seated(customers, fresh, 0.5, np.random.default_rng(2), lm.waiting(customers)), want)
    key = np.arange(20)
    row = {"bucket": 0, "n_words": 5, "keys": key.astype("<i8").tobytes(), "counts": (key % 4 + 1).astype("<u4").tobytes()}
    sizes = []
    monkeypatch.setattr(lm, "waiting", lambda c, plain=lm.waiting: (sizes.append(len(c)), plain(c))[1])
    lm._sampler(row, 4, 5, [np.full(10, 20.0)] * 3)
    assert sizes == [15, 5, 5, 5]  # the pairs that came twice once, the words at the root in each sweep


def test_only_one_table_is_left_beside_the_scores(spark, docs):
    folder = pathlib.Path(work_dir(spark).removeprefix("file://"))
    before = set(folder.glob("llm-*"))
    lm.score(docs({i: f"x{i % 3} y z" for i in range(30)}), 2).collect()
    assert len(set(folder.glob("llm-*")) - before) == 1


def test_no_documents_to_score(none):
    assert lm.score(none).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.stored(stage(spark, docs, PATH))
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left and left <= ids and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.where("n_chars <> length(text)").count() == 0
        ids = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, PATH)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    assert set(queries.QUERIES) >= {f for f in queries.QUERIES if f.startswith("op")} and len(queries.QUERIES) == 13
