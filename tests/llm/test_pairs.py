"""The n-gram join, decontamination and paragraph deduplication against brute force."""

from itertools import combinations

import pytest
from conftest import prose

from opsloom.llm import common
from opsloom.llm import components as C
from opsloom.llm import decontaminate as D
from opsloom.llm import jaccard_join as J
from opsloom.llm import packs
from opsloom.llm import paragraph_dedup as P
from opsloom.llm import words as W


def sets_of(text):
    words = (text or "").encode().lower().split()
    return frozenset(zip(*[words[i:] for i in range(5)], strict=False)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_classes(rows):
    sets = {i: sets_of(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for (i, a), (j, b) in combinations(sets.items(), 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def mutated(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "new" + str(rng.randrange(10_000))
    return " ".join(words)


def corpus(rng):
    base, rows = prose(rng, 120), []
    family = [base]
    for _ in range(150):  # a chain of near copies of near copies
        family.append(mutated(rng, rng.choice(family), rng.randrange(0, 5)))
    rows += [base.upper()] * 20 + family
    line = prose(rng, 12)
    rows += [f"{line}\n{prose(rng, rng.randrange(10, 60))}" for _ in range(80)]
    for _ in range(15):
        t = prose(rng, rng.randrange(5, 200))
        rows += [mutated(rng, t, k) for k in (0, 1, 3, 6)]
    rows += [None, "", " \n", "a", "A", "a b", "a b c d", "x " * 400, "x " * 9]
    return [(1000 - i, t) for i, t in enumerate(rows)]


def test_classes(documents, rng):
    rows = corpus(rng)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.classes(documents(rows)).collect()}
    assert got == brute_classes(rows)


def test_classes_of_repeated_rows_and_none(documents):
    assert J.classes(documents([])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "")]
    got = sorted((r["doc_id"], r["component_id"]) for r in J.classes(documents(rows)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4)]


def plain_distance(item, text):
    """The least edit distance between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        before, row = row, [i + 1]
        for j, v in enumerate(text):
            row.append(min(before[j] + (w != v), before[j + 1] + 1, row[j] + 1))
    return min(row)


def test_decontaminate(spark, documents, rng):
    items = [(i, prose(rng, n)) for i, n in enumerate((6, 9, 16, 25, 40, 59, 80))] + [(50, None), (51, ""), (52, "...")]
    rows = [(k, prose(rng, 150)) for k in range(40)]
    truth = set()
    for k, (i, text) in enumerate(items[:7] * 4):
        edits = (0, 1, 2)[k % 3] if len(text.split()) > 10 else 0
        rows.append((100 + k, f"{prose(rng, rng.randrange(0, 40))} {mutated(rng, text, edits).upper()} {prose(rng, rng.randrange(0, 40))}"))
    rows += [(900, None), (901, ""), (902, "word " * 20_000)]
    for i, text in items:
        for k, t in rows[:-1]:
            item, words = D.bare_words(text or ""), D.bare_words(t or "")
            if item and words and plain_distance(item, words) <= int(D.LIMIT * len(item)):
                truth.add((k, i))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in D.matches(documents(rows), bench).collect()}
    assert set(got) <= truth and len(got) >= 0.95 * len(truth)
    texts, names = dict(rows), dict(items)
    assert all(d >= plain_distance(D.bare_words(names[i]), D.bare_words(texts[k])) for (k, i), d in got.items())
    assert D.matches(documents([]), bench).count() == 0 == D.matches(documents(rows), bench.limit(0)).count()


def test_bit_parallel_distance(rng):
    for _ in range(200):
        item = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 30))]
        text = [rng.randrange(1, 6) for _ in range(rng.randrange(0, 40))]
        import numpy as np

        assert D.best_match(D.Masks(np.array(item)), text)[0] == min(len(item), plain_distance(item, text))


def test_paragraphs(documents, rng):
    passages = [prose(rng, n) for n in (55, 70, 120, 200)]
    rows = [(i, prose(rng, 150)) for i in range(30)]
    holders = {}
    for k, p in enumerate(passages):
        for c in range(5):
            i = 100 + 10 * k + c
            sep = "\n" if c % 2 or len(p.split()) < 100 else " "
            rows.append((i, f"{prose(rng, 30 + c)}{sep}{p}{sep}{prose(rng, 40)}"))
            holders[i] = k
    common = prose(rng, 13)
    rows += [(300 + i, f"{prose(rng, 60)}\n{common}\n{prose(rng, 60)}") for i in range(30)]
    rows += [(500, None), (501, ""), (502, "x. " * 5000), (503, prose(rng, 8))]
    found = {r["doc_id"]: r for r in P.clusters(documents(rows)).collect()}
    assert set(found) == set(holders)
    for i, k in holders.items():
        assert found[i]["cluster_id"] == 100 + 10 * k
        assert bool(found[i]["removals"]) == (i % 10 != 0)
    left = {r["doc_id"]: r["text"] for r in P.remove(documents(rows), P.clusters(documents(rows))).collect()}
    assert len(left) == len(rows) and left[500] is None
    for i, k in holders.items():
        kept = " ".join(passages[k].split()[5:-5]) in " ".join(left[i].split())
        assert kept == (i % 10 == 0)
    assert P.clusters(documents([])).count() == 0


def test_equal_passages_wherever_they_lie(documents, rng):
    """Passages of 51 to 100 words: in the middle of a line, without stops, and in short lines."""
    rows, held = [], {}
    for k in range(60):
        words = prose(rng, rng.randrange(51, 101)).split()
        if k % 3:
            words = [w.strip(".") for w in words]
        lines = "\n" if k % 3 == 2 else " "
        for c in range(2):
            passage = " ".join(words) if lines == " " else "\n".join(" ".join(words[i : i + 5]) for i in range(0, len(words), 5))
            before = 20 + rng.randrange(20)
            rows.append((2 * k + c, f"{prose(rng, before)} {passage} {prose(rng, 30)}"))
            held[2 * k + c] = (before, before + len(words))
    found = {r["doc_id"]: r for r in P.clusters(documents(rows)).collect()}
    for i, (a, b) in held.items():
        assert found[i]["cluster_id"] == i - i % 2
        gone = {w for s in found[i]["removals"] for w in range(s["start"], s["end"])}
        assert (gone >= set(range(a, b))) if i % 2 else not gone


def test_equal_passages_whose_parts_are_quoted(documents, rng):
    """Documents with smaller ids quote a sentence each of a passage that others share whole."""
    parts = [prose(rng, 19) + " end%d." % k for k in range(3)]
    rows = [(k + 1, f"{prose(rng, 30)}\n{p}\n{prose(rng, 30)}") for k, p in enumerate(parts)]
    rows += [(i, f"{prose(rng, 25)}\n{chr(10).join(parts)}\n{prose(rng, 25)}") for i in range(10, 40)]
    found = {r["doc_id"]: r for r in P.clusters(documents(rows)).collect()}
    assert {i: r["cluster_id"] for i, r in found.items()} == dict.fromkeys(range(10, 40), 10)
    for i in range(10, 40):
        gone = {w for s in found[i]["removals"] for w in range(s["start"], s["end"])}
        assert gone >= set(range(25, 85)) if i > 10 else not gone


def test_decontaminate_long_items_at_the_limit(spark, documents, rng):
    """Items of 80 to 300 words with as many edits as the limit allows."""
    items = [(i, prose(rng, n)) for i, n in enumerate((80, 120, 200, 300))]
    rows = []
    for k in range(40):
        words = items[k % 4][1].split()
        for e, at in enumerate(rng.sample(range(len(words)), len(words) // 4)):
            words[at] = (f"new{e}", f"{words[at]} more{e}", "")[rng.randrange(3)]
        rows.append((k, f"{prose(rng, 30)} {' '.join(words)} {prose(rng, 30)}"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.matches(documents(rows), bench).collect()}
    assert got >= {(k, k % 4) for k in range(40)}


def test_classes_with_a_shingle_in_every_document(spark, documents, rng, monkeypatch):
    """One line in every document of many partitions, with few shingles to a range and a flush, so that it is hot."""
    monkeypatch.setattr(packs, "RANGE", 2000)
    monkeypatch.setattr(J, "HOT", 40)
    line = prose(rng, 30)
    rows = [(i, f"{line}\n{prose(rng, rng.choice((2, 4, 40)))}") for i in range(400)]
    family = prose(rng, 80)
    rows += [(1000 + i, f"{line} {mutated(rng, family, rng.randrange(4))}") for i in range(150)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.classes(documents(rows).repartition(24)).collect()}
    assert got == brute_classes(rows)


def test_long_words_differ(documents):
    words = ["a" + "x" * 4095 + "b", "b" + "x" * 4095 + "a", "a" + "x" * 4999 + "b", "a" + "x" * 4997 + "yxb"]
    assert len({int(W.word_hashes(w.encode())[0]) for w in words}) == 4
    assert W.word_hashes(" ".join(words * 60).encode()).tolist() == [int(W.word_hashes(w.encode())[0]) for w in words] * 60
    rows = [(i, w) for i, w in enumerate(words)] + [(9, words[2])]
    assert {r["doc_id"]: r["component_id"] for r in J.classes(documents(rows)).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 9: 2}


def test_classes_without_ids(documents):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (None, None), (8, "other words")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.classes(documents(rows)).collect()), key=str)
    assert got == sorted([(None, 2, 7), (None, 2, 7), (7, 2, 7), (None, 0, None), (8, 1, 8)], key=str)


def test_similar_paragraphs(documents, rng):
    """Lines of 60 to 120 words with insertions, deletions and substitutions: those of a similarity of 0.75 or more with
    another are found, and no others. Every such pair collides with a probability of 0.98 at least."""
    rows, lines = [], {}
    for k in range(40):
        base = prose(rng, rng.randrange(60, 120)).split()
        for c in range(4):
            words = list(base)
            for _ in range(c * rng.randrange(1, 4)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = rng.choice(([], [f"new{rng.randrange(10**6)}"], [words[at], f"more{rng.randrange(10**6)}"]))
            i = 10 * k + c
            lines[i] = " ".join(words)
            rows.append((i, f"{prose(rng, 30)}\n{lines[i]}\n{prose(rng, 30)}"))
    sets = {i: sets_of(t) for i, t in lines.items()}
    linked = {i for i, s in sets.items() if any(j != i and j // 10 == i // 10 and len(s & o) >= 0.75 * len(s | o) for j, o in sets.items())}
    found = {r["doc_id"]: r for r in P.clusters(documents(rows)).collect()}
    near = {i for i in found if i in linked}
    equal = {i for i, t in lines.items() if any(i != j and shares(t, o) for j, o in lines.items() if j // 10 == i // 10)}
    assert set(found) <= linked | equal and equal <= set(found)
    assert len(near) >= 0.95 * len(linked) and len(linked - equal) > 5


def shares(a, b):
    """Whether two texts have 50 words in a row in common."""
    x, y = a.split(), b.split()
    own = {tuple(x[i : i + 50]) for i in range(len(x) - 49)}
    return any(tuple(y[i : i + 50]) in own for i in range(len(y) - 49))


def test_paragraphs_around_a_common_passage(documents, rng):
    """A passage in the middle of a line of every document: the passage repeats, the lines around it aren't alike."""
    passage = prose(rng, 70)
    rows = [(i, f"{prose(rng, rng.randrange(30, 50))} {passage} {prose(rng, rng.randrange(30, 50))}") for i in range(300)]
    found = {r["doc_id"]: r for r in P.clusters(documents(rows).repartition(20)).collect()}
    assert set(found) == set(range(300)) and {r["cluster_id"] for r in found.values()} == {0}
    for i, t in rows:
        at = len(t.split(passage)[0].split())
        # A word or two beside the passage may be another document's too.
        assert len(found[i]["removals"]) == bool(i)
        assert all(at - 3 <= s["start"] <= at and at + 70 <= s["end"] <= at + 73 for s in found[i]["removals"])


def test_removal_keeps_other_white_space():
    assert P.without("one  two   three four", [{"start": 3, "end": 4}]) == "one  two   three "
    assert P.without("a\tb \n c  d", [{"start": 1, "end": 2}]) == "a\t\nc  d" and P.without(None, None) is None and P.without("x", []) == "x"


def test_decontaminate_short_items_at_the_limit(spark, documents, rng):
    """Items of 8 to 31 words with as many edits as the limit allows: nearly all are found."""
    items = [(i, prose(rng, 8 + i)) for i in range(24)]
    rows, want = [], set()
    for k in range(240):
        words = items[k % 24][1].split()
        for at in rng.sample(range(len(words)), len(words) // 4):
            words[at] = (f"new{at}", f"{words[at]} more{at}", "")[rng.randrange(3)]
        rows.append((k, f"{prose(rng, 30)} {' '.join(words)} {prose(rng, 30)}"))
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.matches(documents(rows), bench).collect()}
    assert sum((k, k % 24) in got for k in range(240)) >= 0.95 * 240


def test_decontaminate_long_texts_in_pieces(documents, spark, rng, monkeypatch):
    """An item that lies across the cut of two pieces is found, at its place in the whole text."""
    item = prose(rng, 40)
    pieces = list(D.slices_of(__import__("pyarrow").array(["a b c " * 100_000]), D.WordIds({"a": 1, "b": 2, "c": 3}), 50))
    assert [p[1] for held in pieces for p in held] == [0, 200_000] and len(pieces[0][0][2]) == 200_050
    before = prose(rng, D.PIECE - 20)
    rows = [(1, f"{before} {item} {prose(rng, 50)}")]
    got = D.matches(documents(rows), spark.createDataFrame([("x", item)], "item_id string, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["distance"], r["end_word"]) for r in got] == [(1, "x", 0, len(D.bare_words(rows[0][1].split(item)[0])) + 40)]


def test_filler_is_no_passage(documents, rng):
    """Runs of one word and of a phrase that two documents share, beside a passage that they share."""
    filler, phrase, passage = "ing " * 80, "one two three, " * 30, prose(rng, 60)
    rows = [(i, f"{prose(rng, 40)} {filler} {phrase}\n{filler}\n{prose(rng, 40)}") for i in range(6)] + [(10 + i, f"{prose(rng, 30)} {filler}{passage} {prose(rng, 30)}") for i in range(2)]
    found = {r["doc_id"]: [tuple(s) for s in r["removals"]] for r in P.clusters(documents(rows)).collect()}
    assert set(found) == {10, 11} and found[10] == [] and found[11][0][0] <= 110 and found[11][0][1] >= 170


def test_varied_windows(rng):
    import numpy as np

    words = [rng.randrange(1, 30 if k % 3 else 4) for k in range(400)] + [7] * 120 + list(range(100, 260))
    g = W.grams(np.array(words, dtype=np.uint64), 5)
    want = [2 * len(set(g[i : i + 46].tolist())) >= 46 for i in range(len(g) - 45)]
    assert P.varied(g).tolist() == want and True in want and False in want


def test_hot_passages_take_the_same_way_out(documents, rng, monkeypatch):
    """With few entries to a range, a passage of every document is hot: it passes the ranges by, with the same result."""
    passage, other = prose(rng, 70), prose(rng, 60)
    rows = [(i, f"{prose(rng, 40)} {passage} {prose(rng, 40)}") for i in range(120)] + [(200 + i, f"{prose(rng, 30)}\n{other}\n{prose(rng, 30)}") for i in range(3)]
    result = lambda: {r["doc_id"]: (r["cluster_id"], [tuple(s) for s in r["removals"]]) for r in P.clusters(documents(rows).repartition(8)).collect()}
    plain = result()
    monkeypatch.setattr(packs, "RANGE", 500)
    monkeypatch.setattr(packs, "HOT", 50)
    monkeypatch.setattr(J, "HOT", 50)
    assert result() == plain and len(plain) == 123


def test_pairs_that_meet_late_are_not_formed(spark):
    rows = spark.createDataFrame([(8, 0, 8, 0), (8, 1, 8, 1), (8, 1, 8, 2), (8, 2, 6, 0)], "n int, pos int, m int, at int")
    assert [r[0] for r in rows.select(J.enough_left(*[rows[c] for c in ("n", "pos", "m", "at")])).collect()] == [True, True, False, True]


def brute_components(links):
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {a: find(a) for a in parent}


@pytest.mark.parametrize("few", [0, 30, C.FEW])
def test_components(spark, rng, monkeypatch, few):
    """Chains, stars, cycles and random links, of numbers and of texts, and ends that are null; by rounds, and at once."""
    monkeypatch.setattr(C, "FEW", few)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 240)] + [(399, i) for i in range(360, 399)]
    links += [(400 + i, 400 + (i + 1) % 25) for i in range(25)] + [(rng.randrange(500, 800), rng.randrange(500, 800)) for _ in range(170)]
    links += [(900, 900), (None, 901), (902, None), (-5, 200), (201, -5), (201, -5)]
    got = C.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["id"]: r["comp"] for r in got} == brute_components(links) and len(got) == len({r["id"] for r in got})
    named = [tuple(None if x is None else f"n{x:04d}" for x in link) for link in links]
    assert {r["id"]: r["comp"] for r in C.components(spark.createDataFrame(named, "a string, b string")).collect()} == brute_components(named)
    assert C.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_rows_of_components_grow_as_the_links(spark, monkeypatch):
    """A chain whose two ends have the smallest ids: one end's id has to reach the other's whole half."""
    rows, write = [], common.Tables.write

    def counted(self, df, name):
        rows.append((out := write(self, df, name)).count())
        return out

    monkeypatch.setattr(common.Tables, "write", counted)
    monkeypatch.setattr(C, "FEW", 0)
    half = 40
    chain = list(range(1, 2 * half, 2)) + list(range(2 * half, 0, -2))
    got = C.components(spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "a bigint, b bigint")).collect()
    assert {r["id"]: r["comp"] for r in got} == dict.fromkeys(range(1, 2 * half + 1), 1)
    assert sum(rows) <= 20 * 2 * half and len(rows) <= 40


def test_rounds_read_what_is_apart_only(documents, rng, monkeypatch):
    read, apart = [], J.apart

    def counted(rows, labels):
        out = apart(rows, labels)
        read.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(J, "apart", counted)
    rows = corpus(rng)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.classes(documents(rows)).collect()}
    assert got == brute_classes(rows)
    assert len(read) > 1 and all(b[0] == a[1] < read[0][0] for a, b in zip(read, read[1:], strict=False))


def test_shuffles_of_entries_carry_what_is_read(documents, rng, monkeypatch):
    """Sources are found behind the first shuffle, and keys aren't read behind the second."""
    sent, by_group = [], packs.by_group

    def seen(found, *others):
        sent.append(set(found.columns) - {"group"})
        return by_group(found, *others)

    monkeypatch.setattr(packs, "by_group", seen)
    passage = prose(rng, 60)
    P.clusters(documents([(i, f"{prose(rng, 20)} {passage}") for i in range(3)]))
    assert [c for c in sent if "doc" in c] == [{"key", "doc", "at"}, {"key", "doc"}, {"key", "doc", "at"}, {"doc", "at", "source"}]
