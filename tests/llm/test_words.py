"""Operators that are held against a plain brute-force version over texts."""

import hashlib
import re
from collections import Counter

import pyarrow as pa
import pytest

from lexmill.llm.batches import parts
from tests.llm.corpus import corpus, edges, frame, sentence, tables

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    return corpus() + edges()


def test_quality_rules_match_brute_force(spark, rows):
    from lexmill.llm.quality_rules import quality_rules

    def expected(doc_id, text):
        text = text or ""
        words = SPACE.findall(text)
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        again = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        return (doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed)

    got = quality_rules(frame(spark, rows, clash=True))
    want = sorted((expected(r[0], r[1]) for r in rows), key=repr)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want


def test_quality_rules_host_verdicts(spark):
    from lexmill.llm.quality_rules import quality_rules

    text = " ".join(f"word{i}" for i in range(80))
    rows = [(i, text if i % 20 else "short", "en", "good", 1) for i in range(100)] + [(200 + i, "short" if i % 10 else text, "en", "bad", 1) for i in range(100)]
    rows += [(500, text, "en", "tiny", 1), (501, "short", "en", "other", 1)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(frame(spark, rows)).collect()}
    assert kept[1] and not kept[0] and not kept[200] and not kept[201]
    assert kept[500], "one good document of a small host is not condemned"


def test_license_scan_matches_brute_force(spark, rows):
    from lexmill.llm.license_scan import license_scan

    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    extra = [(2000, "The MIT\tLicense. mit-license! GNU General Public  License", "en", "s", 1), (2001, "Licenced under the Apache Licence, Version 2.0", "en", "s", 1), (2002, "all right reserved by nobody", "en", "s", 1)]

    def expected(doc_id, text):
        words = ALNUM.findall(lower(text))
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        return (doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))

    found = license_scan(frame(spark, rows + extra, clash=True))
    assert rows_of(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted((expected(r[0], r[1]) for r in rows + extra), key=repr)
    by = {r["doc_id"]: r for r in found.collect()}
    assert by[2001]["labels"] == "apache" and by[2001]["base_labels"] == "" and 0.9 < by[2001]["score"] < 1
    assert by[2001]["spans"][0]["first_word"] == 0 and by[2001]["spans"][0]["edits"] == 2
    assert by[2002]["labels"] == "proprietary" and by[2000]["labels"] == "gpl,mit" and by[2000]["score"] == 1


def test_license_seeds_miss_no_bounded_match():
    """Against the regex library over whole texts: substitutions, deletions and insertions, alone and mixed."""
    import random

    import regex

    from lexmill.llm.license_scan import NOTICES, Scanner, scan

    scanner, rng = Scanner(), random.Random(1)
    whole = [regex.compile(f"(?b)(?:{regex.escape(t)}){{e<={len(t) // 10}}}") for t, _ in NOTICES]
    for text, _ in NOTICES:
        k = len(text) // 10
        for trial in range(24):
            edited = list(text)
            for _ in range(k + (trial % 8 == 7)):  # some have one edit too many
                at, kind = rng.randrange(len(edited)), trial % 4 if trial % 4 < 3 else rng.randrange(3)
                edited[at : at + (kind != 2)] = rng.choice([["x"], [], ["z"]][kind : kind + 1])
            inside = " ".join(f"aa bb {''.join(edited)} cc dd".split())
            found = scanner.spans(inside)
            matches = [(m.start(), m.end(), sum(m.fuzzy_counts)) for m in (p.search(inside) for p in whole) if m]
            for a, b, edits in matches:
                assert any(x < b and a < y and e <= edits for _, x, y, e in found), inside
            assert bool(found) == bool(matches)
            for number, a, b, edits in found:
                exact = regex.fullmatch(f"(?:{regex.escape(NOTICES[number][0])}){{e<={edits}}}", inside[a:b])
                assert exact, "a span is a match with its edits"
            one = scan(inside, scanner)
            assert one["labels"] - one["base"] <= {NOTICES[n][1] for n, *_ in found} and {x[0] for x in one["spans"]} == {NOTICES[n][1] for n, *_ in found}
            for (label, first, end, _), (_, a, b, _) in zip(one["spans"], found, strict=True):
                words = inside.split(" ")
                assert set(inside[a:b].split()) <= set(" ".join(words[first:end]).split()) or inside[a:b].strip() in " ".join(words[first:end]), label


def components(rows):
    sets = []
    for _, text, *_ in rows:
        words = SPACE.findall(lower(text))
        sets.append(set(zip(words, words[1:], strict=False)) or ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r[0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sets, [low[root(i)] for i in range(len(rows))], [root(i) for i in range(len(rows))]


def test_near_duplicates_match_brute_force(spark, rows):
    from lexmill.llm.minhash_dedup import keep_one_of_each, near_duplicates

    sets, low, _ = components(rows)
    want = sorted(((r[0], len(s), c, r[0] == c) for r, s, c in zip(rows, sets, low, strict=True)), key=repr)
    want = sorted(((d, n, c, True if c is None else k) for d, n, c, k in want), key=repr)
    assert rows_of(near_duplicates(frame(spark, rows, clash=True)), "doc_id", "n_shingles", "component_id", "kept") == want
    plain = corpus()
    _, low, root = components(plain)
    one = keep_one_of_each(frame(spark, plain, clash=True))
    assert sorted(r["doc_id"] for r in one.select("doc_id").collect()) == sorted(set(low))
    assert one.columns == frame(spark, plain, clash=True).columns
    twice = keep_one_of_each(frame(spark, plain + plain))
    assert sorted(r["doc_id"] for r in twice.select("doc_id").collect()) == sorted(set(low))


def test_near_duplicates_of_a_large_family(spark):
    """A hub with copies on both sides of the threshold: families are compared in blocks."""
    import random

    from lexmill.llm import minhash_dedup

    rng = random.Random(5)
    base = sentence(rng, 100).split(" ")
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 2, 4, 7, 12, 16])):
            words[rng.randrange(len(words))] = rng.choice("abcdefgh") + str(rng.randrange(1000))
        rows.append((i, " ".join(words), "en", "s", 1))
    rows += [(200 + i, " ".join(rows[100][1].split(" ")[: 96 + i % 3]), "en", "s", 1) for i in range(6)]
    _, low, _ = components(rows)
    old, minhash_dedup.BLOCK = minhash_dedup.BLOCK, 16
    try:
        got = minhash_dedup.near_duplicates(frame(spark, rows))
    finally:
        minhash_dedup.BLOCK = old
    wrong = sum(a["component_id"] != dict(zip([r[0] for r in rows], low, strict=True))[a["doc_id"]] for a in got.collect())
    assert wrong == 0


def test_near_duplicates_meet_beside_unlike_pivots(spark):
    """Two near-copies among partial copies with smaller ids, which are the pivots of all their buckets and too short for a link."""
    import random

    from lexmill.llm.minhash_dedup import near_duplicates

    rng = random.Random(11)
    lines = [[f"{rng.choice('bcdfgh')}{i}x{j}" for j in range(10)] for i in range(40)]
    text = lambda chosen: "\n".join(" ".join(x) for x in chosen)
    near = [list(x) for x in lines]
    for at in rng.sample(range(400), 11):
        near[at // 10][at % 10] = "other"
    rows = [(i, text(lines[j] for j in sorted(rng.sample(range(40), 31))), "en", "s", 1) for i in range(150)]
    rows += [(500, text(lines), "en", "s", 1), (501, text(near), "en", "s", 1)]
    _, low, _ = components(rows)
    assert low[-2:] == [500, 500]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == dict(zip([r[0] for r in rows], low, strict=True))


def test_token_counts_match_whole_texts(spark, rows):
    from tokenizers import Tokenizer

    from lexmill.llm import token_counts as T

    extra = [(3000, "a<|endoftext|>b " * 3000, "en", "s", 1), (3001, "x" * 40000, "en", "s", 1), (3002, "it's  two   spaces\n\n 42 and\ttabs " * 2000, "en", "s", 1)]
    t = Tokenizer.from_file(T.default_tokenizer())
    want = sorted(((r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False))) for r in rows + extra), key=repr)
    found = T.token_counts(frame(spark, rows + extra, clash=True), batch_bytes=5000, piece_chars=64)
    assert rows_of(found, "doc_id", "n_bytes", "n_tokens") == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in found.collect())


def test_decontamination_matches_brute_force(spark, rows):
    from lexmill.llm.decontamination import decontamination, remove_contaminated

    texts = [r[1] for r in rows if r[1]]
    cut = lambda t, a, b: " ".join(ALNUM.findall(lower(t))[a:b])
    bench = [(1, cut(texts[0], 0, 14)), (2, cut(texts[1], 1, 11)), (3, cut(texts[2], 0, 4)), (4, "no such words here at all"), (5, ""), (6, None), (7, "Single"), (8, "alpha beta 3 gamma delta epsilon 3 alpha beta 4 gamma"), (1, cut(texts[0], 0, 14)), (10, cut(texts[1], 1, 11)), (None, cut(texts[5], 0, 12))]

    def expected(doc_id, text):
        words, hit, items = ALNUM.findall(lower(text)), set(), set()
        for item, t in bench:
            own = ALNUM.findall(lower(t))
            size = min(10, len(own))
            for a in range(max(1, len(own) - 9) if own else 0):
                for i in range(len(words) - size + 1):
                    if words[i : i + size] == own[a : a + size]:
                        hit.update(range(i, i + size))
                        items.add(item)
        named = sorted(str(x) for x in items if x is not None)
        return (doc_id, len(words), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit))

    short = [r if r[0] != 1007 else (1007, r[1][:4000], *r[2:]) for r in rows]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    want = sorted((expected(r[0], r[1]) for r in short), key=repr)
    for limit in (10**6, 0):  # broadcast, and dealt by shingle
        found = decontamination(frame(spark, short, clash=True), benchmark, broadcast_rows=limit)
        assert rows_of(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    clean = remove_contaminated(frame(spark, short, clash=True), benchmark)
    bad = Counter(w[0] for w in want if w[5])
    assert clean.count() == len(short) - sum(bad.values()) and clean.columns == frame(spark, short, clash=True).columns
    assert decontamination(frame(spark, short), benchmark.limit(0)).filter("contaminated").count() == 0


def test_line_dedup_drops_recurring_lines(spark, rows, tmp_path):
    from lexmill.llm.line_dedup import drop_recurring, line_dedup

    passage = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55))
    own = [(i, f"own line of document {chr(97 + i)} alone\n{passage}\nlast {chr(97 + i)} words of it", "en", "s", 1) for i in range(2)]
    logs = [(10 + i, f"user logged in as {name} from host {i} at noon today\n{name} wrote of {name * 3} and {name[::-1]}", "en", "s", 1) for i, name in enumerate(["ann", "bob", "cyd", "dan"])]
    short = [(30 + i, f"ok then\n{chr(97 + i) * 3} {chr(98 + i) * 4} {chr(99 + i) * 5} {chr(100 + i) * 6}", "en", "s", 1) for i in range(4)]
    found = {r["doc_id"]: r for r in line_dedup(frame(spark, own + logs + short, clash=True)).collect()}
    assert passage in found[0]["text"] and passage not in found[1]["text"] and "own line of document b alone" in found[1]["text"]
    assert found[10]["n_dropped"] == 0 and all(found[i]["text"] == f"{n} wrote of {n * 3} and {n[::-1]}" for i, n in ((11, "bob"), (12, "cyd"), (13, "dan")))
    assert all(found[30 + i]["n_dropped"] == 0 for i in range(4)), "short lines stay"
    all_rows = line_dedup(frame(spark, rows, clash=True))
    assert all_rows.count() == len(rows) and {r["text"] for r in all_rows.filter("doc_id = 1000").collect()} == {None}
    kept = drop_recurring(frame(spark, rows, clash=True))
    assert kept.columns == frame(spark, rows, clash=True).columns and kept.filter("doc_id = 1000").count() == 1


def test_line_dedup_tells_templates_of_one_leaf_apart(spark):
    """Four interleaved templates of one length and opening, each with a variable field, and single lines among them."""
    from lexmill.llm import line_dedup as L

    names = ["ann", "bob", "cyd", "dan", "eve"]
    forms = [
        "2024 INFO main user {} logged in from the office at noon", "2024 INFO main disk of {} is nearly full again since last week",
        "2024 INFO main mail to {} could not be sent by this server", "2024 INFO main job for {} was done without any fault or delay",
    ]
    rows = [(i, "\n".join(f.format(n) for f in forms), "en", "s", 1) for i, n in enumerate(names)]
    rows += [(50 + i, "2024 INFO main " + " ".join(f"{c}{j}" .replace("1", "x").replace("0", "y") for j in "abcdefgh"), "en", "s", 1) for i, c in enumerate("pqrs")]
    for limit in (10**6, 0):  # leaves broadcast, and dealt
        found = {r["doc_id"]: r for r in L.line_dedup(frame(spark, rows), broadcast_rows=limit).collect()}
        assert found[0]["n_dropped"] == 0 and [found[i]["n_dropped"] for i in range(1, 5)] == [4] * 4
        assert all(found[50 + i]["n_dropped"] == 0 for i in range(4))


def test_line_dedup_spares_near_copies(spark):
    import random

    from lexmill.llm.line_dedup import drop_recurring

    rng = random.Random(2)
    passage, own = sentence(rng, 60), [[sentence(rng, 55) for _ in range(3)] for _ in range(3)]
    near = [own[0][0], own[0][1].replace(own[0][1].split(" ")[9], "another", 1), own[0][2]]
    rows = [(0, "\n".join([*own[0], passage]), "en", "s", 1), (1, "\n".join([*near, passage]), "en", "s", 1), (2, "\n".join([own[1][0], passage, own[1][1]]), "en", "s", 1)]
    rows += [(3, "\n".join([*own[0], passage]), "en", "s", 1), (4, "\n".join([own[0][0], own[2][0], own[2][1], own[2][2]]), "en", "s", 1)]
    left = {r["doc_id"]: r["text"].split("\n") for r in drop_recurring(frame(spark, rows), spare=0.7).collect()}
    assert left == {0: [*own[0], passage], 1: [*near, passage], 2: [own[1][0], own[1][1]], 3: [*own[0], passage], 4: own[2]}
    plain = {r["doc_id"]: r["text"] for r in drop_recurring(frame(spark, rows)).collect()}
    assert 3 not in plain and all(i == 0 or passage not in text for i, text in plain.items())


def test_stages_keep_rows_whole(spark):
    """Every helper column's name is taken by the caller's table: its values stay, and no row is lost or made."""
    from lexmill.llm import decontamination, line_dedup, minhash_dedup, mixing, quality_rules

    rows = corpus()
    docs = frame(spark, rows, clash=True)
    benchmark = spark.createDataFrame([(1, " ".join(rows[0][1].split()[:14]))], "item_id long, text string")
    for name, found in (
        ("lines", line_dedup.drop_recurring(docs, spare=0.7)), ("copies", minhash_dedup.keep_one_of_each(docs)),
        ("benchmark", decontamination.remove_contaminated(docs, benchmark)), ("mix", mixing.mix_documents(docs)), ("quality", quality_rules.filter_quality(docs)),
    ):
        got = found.collect()
        extra = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
        assert got and found.columns[: len(docs.columns)] == docs.columns and all(r[c] == "other" for r in got for c in extra), name
        if name != "lines":
            assert {tuple(r[:5]) for r in got} <= set(rows), name
        if name != "mix":
            assert len(got) == len({r["doc_id"] for r in got}) and found.columns == docs.columns, name


def test_filter_quality_judges_rows(spark):
    from lexmill.llm.quality_rules import filter_quality

    good = " ".join(f"word{i}" for i in range(80))
    rows = [(None, good, "en", "s", 1), (None, "short", "en", "s", 1), (1, good, "en", "s", 1), (1, "short", "en", "s", 1), (2, good, "en", "s", 1), (2, good, "en", "s", 1)]
    assert rows_of(filter_quality(frame(spark, rows)), "doc_id", "text") == sorted([(None, good), (1, good), (2, good), (2, good)], key=repr)


def test_token_batches_are_bounded_by_bytes(spark, monkeypatch):
    import pyarrow as pa

    from lexmill.llm import token_counts as T

    seen = []

    class Spy:
        def encode_batch_fast(self, texts, add_special_tokens):
            seen.append(sum(len(t.encode()) for t in texts))
            return [[0]] * len(texts)

    monkeypatch.setattr(T, "_tokenizer", lambda path: Spy())
    texts = ["\u4e2d\u6587 " * 400, "plain words " * 300, None, "", "\u00e9 " * 900] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(25)), pa.array([0] * 25), pa.array(texts)], names=["doc_id", "n_bytes", "text"])
    assert [x.num_rows for x in T._lengths("", 2000, 64)(iter([batch]))] == [25]
    assert max(seen) <= 2000 and sum(seen) > 15_000 and len(seen) < 40


def test_sql_twins(spark, tmp_path):
    import duckdb

    from lexmill.llm import registry

    folder = tables(spark, tmp_path, corpus(), clash=False, benchmark=[(1, corpus()[0][1]), (2, "a b")])
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, folder)
        want = c.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns), name
        assert rows_of(got, *columns) == sorted(want.fetchall(), key=repr), name


def test_parts_are_bounded_by_bytes():
    texts = ["ab", None, "", "x" * 50, "ééé", "abc", "y" * 9, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string()), pa.array(["z"] * len(texts))], names=["id", "a", "b"])
    found = list(parts(iter([batch, batch.slice(2, 3), batch.slice(0, 0)]), "a", "b", size=12))
    assert [i for p in found for i in p.column("id").to_pylist()] == [*range(8), 2, 3, 4]
    size = lambda p: sum(len((t or "").encode()) for c in "ab" for t in p.column(c).to_pylist())
    assert all(size(p) <= 12 or p.num_rows == 1 for p in found)
    assert [p.num_rows for p in found] == [3, 1, 2, 2, 1, 1, 1]
