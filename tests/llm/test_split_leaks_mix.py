import random
import re
from datetime import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslab.llm import leaks, mixing, split


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Sentence here. ", "x" * 50 + " ", "\n", "\n\n", "boat shed flag! ", "y" * 1300]), min_size=1, max_size=400))
def test_pieces_cover_the_text(parts):
    text = "".join(parts)
    level, spans = split.split_text(text)
    assert all(b - a <= 1200 for a, b in spans)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        assert a < c <= b < d
        assert 1 <= b - c <= 200 or b - a < 300
    assert level == split.cut_level(text, 1200)


def test_cut_levels_and_boundaries():
    par = ("Some plain words of a paragraph here. " * 20).strip()
    assert split.cut_level(f"{par}\n \n{par}", 1200) == "paragraph"
    assert split.cut_level(par + " " + par, 1200) == "sentence"
    assert split.cut_level("word " * 400, 1200) == "word"
    assert split.cut_level("x" * 1300, 1200) == "none"
    _, spans = split.split_text(f"{par}\n\n{par}\n\n{par}")
    assert {b for _, b in spans[:-1]} <= {len(par) + 2, 2 * len(par) + 4}
    topic = "boat oar river crew cox. " * 20 + "shirt sock boot lace kit. " * 22
    assert abs(split.split_text(topic, 1000)[1][0][1] - 500) < 60


def test_boundaries_of_marked_paragraphs():
    """A boundary before a bullet or a quote has the valley of the word that follows the mark."""
    boats, kit = "- boat oar river crew cox boat oar river.", "- shirt sock boot lace kit shirt sock."
    text = "\n\n".join([boats] * 12 + [kit] * 14)
    level, pieces = split.split_pieces(text, 900)
    assert level == "paragraph" and {k for _, _, k in pieces} <= {"paragraph", "end"}
    assert pieces[0][1] == len("\n\n".join([boats] * 12)) + 2
    assert split.split_pieces("x" * 1300)[1] == [(0, 1200, "none"), (1040, 1300, "end")]


def test_valleys_equal_plain_cosines():
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefg") for _ in range(200))
    places, depths = split.valley_depths(text, 10)
    words = text.split()

    def cosine(g):
        left, right = words[max(0, g - 10) : g], words[g : g + 10]
        dot = sum(left.count(w) * right.count(w) for w in set(left))
        norm = (sum(left.count(w) ** 2 for w in set(left)) * sum(right.count(w) ** 2 for w in set(right))) ** 0.5
        return dot / norm if norm else 0.0

    sims = [cosine(g) for g in range(200)]
    for g in range(200):
        i = j = g
        while i > 0 and sims[i - 1] >= sims[i]:
            i -= 1
        while j < 199 and sims[j + 1] >= sims[j]:
            j += 1
        assert abs(depths[g] - (sims[i] + sims[j] - 2 * sims[g])) < 1e-9
    assert places == [2 * i for i in range(200)]


def test_split_oversized(frame):
    schema = "doc_id string, text string, loaded_at timestamp_ntz, piece string, cut_level string"
    rows = [("a", "w " * 700, dt(2025, 1, 2), None, "x"), ("a", "short", dt(2025, 1, 1), None, None), ("a", "w " * 700, dt(2025, 1, 2), None, "x"), ("b", "x" * 1200, dt(2025, 1, 1), None, None), ("c", None, None, None, None), ("d", "", None, None, None), (None, "y" * 5000, None, None, None), ("e", "z" * 200_000, None, None, None)]
    got = split.split_oversized(frame(rows, schema)).collect()
    assert {(r.doc_id, r.cut_level) for r in got} == {("a", "word"), ("e", "none")}
    assert all(len(r.piece) <= 1200 and len(r.piece) == r.stop - r.start for r in got)
    assert split.split_oversized(frame([], schema)).count() == 0


def brute_leaks(docs, items, least):
    def grams(t):
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        return {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}

    return {(i, d) for i, t in items for d, u in docs if i is not None and d is not None and grams(t) & grams(u)}


def test_leaks_equal_brute_force(frame):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(12)]

    def words(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    items = [(i, words(rng.randint(0, 30))) for i in range(12)] + [(50, None), (None, words(9)), (51, "one two three")]
    docs = [(d, words(40)) for d in range(30)]
    for d in range(30, 60):
        i, t = rng.choice(items[:12])
        w = t.split()
        a = rng.randint(0, max(0, len(w) - 8))
        docs.append((d, f"{words(5)} {', '.join(w[a : a + 8]).upper()} {words(5)}"))
    docs += [(90, None), (91, ""), (92, docs[31][1]), (None, docs[31][1]), (93, "é" * 10_000 + " " + docs[31][1])]
    df = frame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    it = frame([(i, "c", t) for i, t in items], "item_id long, category string, text string")
    for chars in (100, 3_000_000):
        found = leaks.leaked_passages(df, it, 8, chars)
        assert {(r.item_id, r.doc_id) for r in found.collect()} == brute_leaks(docs, items, 8)
    in_blocks = leaks.leaked_passages(df, it, 8, suite_chars=300)
    assert sorted(map(tuple, in_blocks.select("item_id", "doc_id", "words").collect())) == sorted(map(tuple, found.select("item_id", "doc_id", "words").collect()))
    clean = {r.doc_id for r in leaks.without_leaks(df, found).collect()}
    assert clean == {d for d, _ in docs} - {d for _, d in brute_leaks(docs, items, 8)}
    by = {r.item_id: r.docs for r in leaks.leaks_by_item(it, found).collect()}
    assert by[51] == 0 and sum(by.values()) == len(brute_leaks(docs, items, 8))
    assert leaks.leaked_passages(df, it.limit(0)).count() == 0 and leaks.leaked_passages(df.limit(0), it).count() == 0


def test_longest_match(frame):
    doc = "a b c d e f g h i j k l"
    row = leaks.leaked_passages(frame([(1, "x y " + doc)], "doc_id long, text string"), frame([(7, "q " + doc + " r")], "item_id long, text string")).first()
    assert tuple(row) == (7, 1, 12, 1, 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8))
def test_pfair_stays_within_one_block(weights):
    slots = sum(weights)
    placed = mixing.pfair_slots(weights, weights, slots)
    assert len({t for t, _, _ in placed}) == slots
    for s, w in enumerate(weights):
        done = 0
        own = {t for t, x, _ in placed if x == s}
        for t in range(slots):
            done += t in own
            assert abs(done - (t + 1) * w / slots) < 1


MIX = "doc_id long, source string, text string, tokens string, block_no string"
GOALS = "source string, target_share double, max_repeat long"


def mixed(frame, docs, goals):
    sized = mixing.documents_with_tokens(frame(docs, MIX))
    plan = mixing.mix_plan(sized, frame(goals, GOALS), 100)
    return sized, plan


def test_mix_reaches_shares(frame):
    docs = [(i, "Big " if i % 2 else "big", "w " * (5 + i % 7), None, None) for i in range(400)]
    docs += [(1000 + i, "small", "w " * 10, None, None) for i in range(20)] + [(2000, None, "w w", None, None), (2001, "other", "w", None, None), (2002, "small", None, None, None), (2003, "small", "", None, None)]
    goals = [("big", 0.5, 1), ("Small", 0.3, 2), ("none", 0.2, 5), (None, 0.1, 1), ("big ", 0.5, 1), ("zero", None, None)]
    sized, plan = mixed(frame, docs, goals)
    assert sorted(r.source for r in mixing.scheduled_shortages(plan, 100).collect()) == ["Small", "none"]
    rows = mixing.mix(sized, plan, 100, 4).collect()
    uses = {}
    for r in rows:
        uses.setdefault((r.source, r.doc_id), []).append(r.use)
    assert all(sorted(u) == list(range(1, len(u) + 1)) for u in uses.values())
    assert max(len(u) for (s, _), u in uses.items() if s == "big") == 1 and {len(u) for (s, _), u in uses.items() if s == "small"} == {2}
    total = sized.agg({"tokens": "sum"}).first()[0]
    big = sum(r.tokens for r in rows if r.source == "big")
    assert 0.5 * total <= big <= 0.5 * total + 12
    slots = {}
    for r in rows:
        slots[r.slot] = slots.get(r.slot, 0) + r.tokens
    shares = {r.source: r for r in mixing.mix_shares(mixing.mix(sized, plan, 100, 4), plan).collect()}
    assert shares["none"].used_tokens == 0 and abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9


def test_empty_mix(frame):
    for docs, goals in (([], [("a", 1.0, 1)]), ([(1, "a", "w", None, None)], []), ([], [])):
        sized, plan = mixed(frame, docs, goals)
        assert mixing.scheduled_shortages(plan, 100).count() == 0
        assert mixing.mix(sized, plan, 100).count() == (0 if not docs or not goals else 1)
        mixing.mix_shares(mixing.mix(sized, plan, 100), plan).collect()
