"""Pairs and lines that SimHash and five-word tokens alone would leave, against brute force."""

from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np

from linkloom.llm import lines, neardup, simhash


def _texts():
    """Texts, ever more of whose words are changed, around several first ones; and short ones."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(3000)])
    out = []
    for _ in range(12):
        first = rng.choice(words, int(rng.integers(20, 200)))
        for changed in range(8):
            text = first.copy()
            text[rng.choice(len(text), min(changed, len(text) // 10), replace=False)] = rng.choice(words, min(changed, len(text) // 10))
            out.append(" ".join(text))
        out += [" ".join(first[: len(first) * 9 // 10]), " ".join([*first[len(first) // 10 :], "tail"])]
        out.append("\n".join(first).upper())
    return out + ["one two", "one  TWO\n", "one two three four five", "one two three four", "", " \n", None, "é à", "É à"]


def _set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def _components(rows):
    label = {i: i for i, _ in rows}
    held = [(i, _set(t)) for i, t in rows]
    near = [(i, j) for i, a in held for j, b in held if i < j and len(a & b) * 5 >= 4 * len(a | b)]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return label


def test_documents_of_similarity_four_fifths_are_one_group(spark, docs, no_docs):
    rng = np.random.default_rng(6)
    made = _texts()
    made += [made[int(i)] for i in rng.integers(0, len(made), 20)]
    order = rng.permutation(len(made))
    rows = [(int(i), made[k]) for i, k in zip(order, range(len(made)))]
    rows += [(3, "an id that has another text too"), (900, "an id that has another text too")]
    frame = spark.createDataFrame([*rows, (None, made[0]), (None, made[0])], "doc_id long, text string")
    want = _components(rows)
    assert {r.doc_id: r.component_id for r in neardup.similar_documents(frame).collect()} == want
    # The stage keeps the smallest id of each, and rows without an id.
    stayed = corpus_pipeline.near_dedup(spark, frame, "")
    assert Counter(r.doc_id for r in stayed.collect()) == Counter([None, None, *(i for i, _ in rows if want[i] == i)])
    assert neardup.similar_documents(no_docs).count() == 0
    odd = [(r.doc_id, r.text) for r in docs.filter("doc_id is not null").collect()]
    assert {r.doc_id: r.component_id for r in neardup.similar_documents(docs).collect()} == _components(odd)
    assert neardup.keep_one(docs).columns == docs.columns


def test_groups_that_the_first_links_leave_apart_are_compared(spark):
    """The third is like both others, which are not like each other."""
    words = [f"v{i}" for i in range(100)]
    texts = [words, words[8:] + [f"y{i}" for i in range(8)], words[16:] + [f"y{i}" for i in range(16)]]
    for order in ((0, 1, 2), (1, 0, 2), (2, 1, 0), (1, 2, 0)):
        rows = [(i, " ".join(texts[k])) for i, k in enumerate(order)]
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in neardup.similar_documents(frame).collect()}
        assert got == _components(rows) == {0: 0, 1: 0, 2: 0}


def test_the_stage_links_by_fingerprints_and_checks_them(spark, monkeypatch):
    """SimHash's pairs are among those that are verified, in the stage too; no other link than similar sets comes out."""
    given, verified = [], []
    pairs_of, similar = neardup.fingerprint_pairs, lines.SetGroups.similar

    def spy_pairs(frame, held):
        prints = {r.doc_id: r.fp for r in simhash.fingerprints(frame).collect()}
        sets = {r.doc_id: r.line_set for r in held.collect()}
        out = pairs_of(frame, held)
        apart = [(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b]]
        near = {frozenset((sets[a], sets[b])) for a, b in apart if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 3}
        given.append(({frozenset(r) for r in out.collect()}, near))
        return out

    def spy_similar(self, pairs):
        verified.append({frozenset(r) for r in pairs.collect()})
        return similar(self, pairs)

    monkeypatch.setattr(neardup, "fingerprint_pairs", spy_pairs)
    monkeypatch.setattr(lines.SetGroups, "similar", spy_similar)
    words = [f"w{i}" for i in range(2000)]
    texts = [words, [*words[:-1], "other"], [*words[:-1], "last"], words[:40], ["new", *words[:1990]], ["Word", "other"], ["other"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    stayed = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()}
    want = _components(rows)
    assert stayed == {i for i, _ in rows if want[i] == i}
    [(got, near)] = given
    assert near and got <= near and got <= verified[0]
    # The links span what is linked.
    reached = {n for pair in got for n in pair}
    assert reached == {n for pair in near for n in pair}


def test_links_of_fingerprints_stay_whatever_the_sets(spark):
    """All that the operator of fingerprints links is one group, also below a similarity of four fifths, and with all similar sets."""
    rng = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = []
    for n in (40, 150, 300):
        # What repeats outweighs the ends, by which the sets differ.
        body = " ".join(rng.choice(words, n))
        ends = [rng.choice(words, n) for _ in range(3)]
        texts += [" ".join([*[body] * 60, *end]) for end in ends]
        # Like the last of them as sets, but not by fingerprint, as the repeats are gone.
        texts.append(" ".join([body, *ends[-1]]))
        texts.append(" ".join([*ends[-1], body]))
    texts += ["", None, "one two three", " ".join(rng.choice(words, 80))]
    rows = [(int(i), text) for i, text in zip(rng.permutation(len(texts)), texts)]
    prints = {i: simhash._fingerprint((t or "").encode()) for i, t in rows}
    sets = {i: _set(t) for i, t in rows}
    label = {i: i for i, _ in rows}

    def near(i, j):
        both = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        return (prints[i] ^ prints[j]).bit_count() <= 3, both[0] * 5 >= 4 * both[1]

    for _ in rows:
        for i in label:
            for j in label:
                if any(near(i, j)):
                    label[i] = label[j] = min(label[i], label[j])
    # Some links are of one kind alone.
    assert {(True, False), (False, True)} <= {near(i, j) for i in label for j in label}
    frame = spark.createDataFrame([*rows, (None, texts[0])], "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in neardup.similar_documents(frame).collect()} == label
    of = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect() if r.doc_id is not None}
    assert all(label[i] == label[own] for i, own in of.items()) and label != _components(rows)
    stayed = corpus_pipeline.near_dedup(spark, frame, "")
    assert Counter(r.doc_id for r in stayed.collect()) == Counter([None, *(i for i in label if label[i] == i)])


def test_short_lines_are_copies_of_equal_ones(spark):
    """Lines of one to four words are one token; blank ones hold none."""
    texts = ["Home\nAbout us\n\nHome\none two three four five six", "Home \n about us\n\nAbout  us", "one two three four\n \nfour three two one"]
    texts += ["one two three four five six\none two three four\none two three\nHome five"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, want, left = defaultdict(list), set(), {}
    for doc, text in enumerate(texts):
        held = []
        for number, line in enumerate(text.split("\n")):
            words = tuple(line.split())
            if words and seen[words]:
                want.add((doc, number))
            else:
                held.append(line)
            seen[words].append((doc, number))
        left[doc] = "\n".join(held)
    got = lines.repeated_lines(frame, short=True).collect()
    assert {(r.doc_id, r.line_no) for r in got} == want and len(got) == len(want) == 5
    stayed = corpus_pipeline.line_dedup(spark, frame, "")
    assert {r.doc_id: r.text for r in stayed.collect()} == left


def test_only_wanted_texts_move(spark):
    """Texts are packed and shuffled for the check of whole sets only if they hold a line that is compared."""
    rows = [(i, f"alone{i} stands in text {i} and nowhere else\nsecond{i} line{i} of it{i} is its{i} own{i}") for i in range(300)]
    rows += [(None, "no id and one line that two share here"), (7, ""), (7, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) text_key", "text")
    wanted = texts.filter("doc_id in (3, 200) or doc_id is null").select("doc_id", "text_key")
    moved = {(r.doc_id, r.text_key) for r in lines.moved_texts(texts, wanted).collect()}
    assert {tuple(r) for r in wanted.collect()} <= moved and len(moved) <= 5
    assert lines.moved_texts(texts, wanted.filter("false")).count() == 0
