import math
import random

import pytest
from pyspark.sql import functions as F

from trialloom.llm import packing, splitting, subjects, survivors, tokens, top_n
from trialloom.llm.prefixes import mark_prefixes

# Top N ----------------------------------------------------------------------------------------


def test_top_n_matches_brute_force_with_a_hot_group(frame):
    random.seed(3)
    rows = [(random.choice(["hot"] * 5 + ["a", "b", None]), f"i{random.randrange(60)}", random.choice([0.1, 0.5, 0.5, 0.9, None, float("nan"), -0.0, 0.0])) for _ in range(900)]
    out = top_n.top_n_per_group(frame(rows, "g string, id string, s double", 5), ["g"], "s", ["id"], 3).collect()
    best = {}
    for g, i, s in rows:
        if s is not None and s == s:
            best[g, i] = max(best.get((g, i), -9), s)
    want = set()
    for g in {g for g, _ in best}:
        ordered = sorted(((-s, i) for (h, i), s in best.items() if h == g))[:3]
        want |= {(g, i, n) for n, (_, i) in enumerate(ordered, 1)}
    assert {(r.g, r.id, r.position) for r in out} == want


def test_top_n_of_an_empty_table_and_a_bad_n(frame):
    empty = frame([], "g string, id string, s double")
    assert top_n.top_n_per_group(empty, ["g"], "s", ["id"], 3).count() == 0
    with pytest.raises(ValueError):
        top_n.top_n_per_group(empty, ["g"], "s", ["id"], 0)


# Splitting ------------------------------------------------------------------------------------


def _rebuilt(text, limit, overlap):
    flat, _ = splitting.boundaries(text)
    pieces = splitting.split_text(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b, _ in pieces)
    assert all(y[0] == x[1] - min(overlap, limit - 1) for x, y in zip(pieces, pieces[1:], strict=False))
    joined, at = "", 0
    for a, b, _ in pieces:
        joined += flat[max(a, at) : b]
        at = b
    assert joined == flat
    return pieces


def test_split_rebuilds_the_text_and_keeps_limits():
    random.seed(5)
    for _ in range(200):
        words = ["".join(random.choice("abc。,.;") for _ in range(random.choice([1, 3, 9, 60]))) for _ in range(random.randrange(1, 80))]
        text = "".join(w + random.choice([" ", "  ", "\n", "\r\n\r\n", "\t", ". "]) for w in words)
        _rebuilt(text, random.choice([20, 50, 120]), random.choice([0, 5, 15, 90]))


def test_split_prefers_paragraphs_then_sentences_then_hard_cuts():
    text = "First part is here. It goes on.\n\nSecond part follows after it and is long enough to need a cut."
    assert _rebuilt(text, 50, 0)[0] == (0, 31, "paragraph")
    assert _rebuilt("One sentence here. Another sentence is here now.", 30, 0)[0][2] == "sentence"
    assert {k for *_, k in _rebuilt("x" * 95, 30, 10)} == {"hard", "end"}


def test_the_whole_overlap_is_given_below_the_limit():
    text = "word " * 200
    for overlap in (49, 50, 51, 80, 99, 100, 120):
        pieces = _rebuilt(text, 100, overlap)
        assert {x[1] - y[0] for x, y in zip(pieces, pieces[1:], strict=False)} == {min(overlap, 99)}


def test_split_oversized_handles_nulls_and_clashing_columns(frame):
    rows = [("a", "word " * 30, 40, 5, 1), ("a", None, 40, 5, 1), ("b", "", 40, None, 1), (None, "  a \n b ", 3, 1, 1), ("c", "word " * 30, None, 5, 1), ("d", "word " * 30, 0, 5, 1)]
    df = frame(rows, "k string, text string, lim int, lap int, piece_no int")
    out = splitting.split_oversized(df, ["k"], "text", "lim", "lap").collect()
    by = {}
    for r in out:
        by.setdefault(r.k, []).append(r)
    assert len(by["a"]) == 5 + 1 and by["b"][0].piece_text == "" and by[None][0].piece_text == "a b" and len(by["c"]) == len(by["d"]) == 1
    assert all(len(r.piece_text or "") <= 40 for r in by["a"])


# Survivors ------------------------------------------------------------------------------------


def test_prefixes_match_brute_force(frame):
    random.seed(7)
    seen = {(random.choice("xy"), "".join(random.choice("ab ") for _ in range(random.randrange(1, 7)))) for _ in range(300)}
    rows = [(g, t, i) for i, (g, t) in enumerate(sorted(seen))]
    out = {r.i: r.is_prefix for r in mark_prefixes(frame(rows, "g string, t string, i long", 4), ["g"], "t", "i").collect()}
    assert out == {i: any(h == g and u != t and u.startswith(t) for h, u, _ in rows) for g, t, i in rows}


CLAIMS = "g string, id long, text string, src string, rank int, at timestamp"


def _fuse(df, **options):
    return survivors.fuse_fields(df, ["g"], "id", {"text": F.col("text")}, "src", ["one", "two", "three"], [F.col("rank"), -F.unix_micros("at")], **options)


def test_ranked_survivor_prefers_whole_texts_then_trust(frame):
    rows = [
        ("A", 1, "the whole text", "two", 2, None), ("A", 2, "the  whole\ntext", "three", 3, None), ("A", 3, "the whole", "one", 1, None), ("A", 4, "other [truncated]", "one", 1, None),
        ("A", 5, "N/A", "one", 1, None), ("B", 6, "single", "one", 1, None), ("C", 7, None, "one", 1, None), ("C", 8, " - ", "two", 2, None), (None, 9, "x", "one", 1, None), (None, 10, "y", "one", 1, None),
        ("D", 12, "tie", "one", 1, None), ("D", 11, "tie", "one", 1, None),
    ]
    out = {r.g: r for r in _fuse(frame(rows, CLAIMS), cut_off_field="text").survivors.collect()}
    assert {g: r.id for g, r in out.items()} == {"A": 1, "D": 11}
    assert not out["A"].is_cut_off and 0 < out["A"].posterior <= 1


@pytest.mark.parametrize("mark", ["<cut>", "<truncated>", "<more>", "< Cut off >", "[cut]", "(cut)", "…"])
def test_a_text_that_says_it_is_cut_yields_to_a_whole_one(frame, mark):
    rows = [("A", 1, f"begun and {mark}", "one", 1, None), ("A", 2, "another whole text", "two", 2, None), ("B", 3, "weight <cut> level", "one", 1, None), ("B", 4, "another", "two", 2, None)]
    out = {r.g: r.id for r in _fuse(frame(rows, CLAIMS), cut_off_field="text").survivors.collect()}
    assert out == {"A": 2, "B": 3}


def test_copies_are_found_and_discounted(frame):
    random.seed(11)
    rows, n = [], 0
    for item in range(200):
        true = f"t{item}"
        wrong = f"w{item}" if random.random() < 0.5 else true
        for src, value in (("one", true), ("two", wrong), ("three", wrong)):
            n += 1
            rows.append((f"g{item}", n, value, src, 1, None))
    for item in range(200, 300):  # a fourth, independent source confirms the first
        for src, value in (("one", f"t{item}"), ("four", f"t{item}"), ("two", f"w{item}"), ("three", f"w{item}")):
            n += 1
            rows.append((f"g{item}", n, value, src, 1, None))
    fused = _fuse(frame(rows, CLAIMS), policy="posterior")
    assert fused.trust.settled
    assert fused.trust.dependence[2][1] > 0.9
    assert fused.trust.dependence[2][1] > fused.trust.dependence[1][0]
    kept = fused.survivors.collect()
    assert len(kept) == 300 and sum(r.value.startswith("t") for r in kept) >= 0.95 * 300


def _claimed(n_items, seed):
    """Values of three independent sources of different accuracy and one that copies the second."""
    rng = random.Random(seed)
    rows, n = [], 0
    for item in range(n_items):
        said = {s: f"t{item}" if rng.random() < right else f"w{item}-{rng.randrange(10)}" for s, right in (("one", 0.9), ("two", 0.6), ("three", 0.75))}
        said["four"] = said["two"] if rng.random() < 0.9 else f"w{item}-{rng.randrange(10)}"
        for s, v in said.items():
            if rng.random() < 0.9:
                n += 1
                rows.append((f"g{item}", n, v, s, 1, None))
    return rows


def test_only_the_copier_depends_on_its_original_and_the_truth_survives(frame):
    fused = _fuse(frame(_claimed(800, 5), CLAIMS), policy="posterior", min_records=1)
    trust = fused.trust
    assert trust.settled and trust.sources[3] == "(other)"
    assert trust.dependence[3][1] > 0.99
    assert max(trust.dependence[a][b] for a, b in ((0, 1), (0, 2), (1, 2), (0, 3), (2, 3))) < 0.3
    assert [abs(a - b) < 0.1 for a, b in zip(trust.accuracy, (0.9, 0.6, 0.75, 0.55), strict=True)] == [True] * 4
    kept = fused.survivors.collect()
    by_count = {}
    for g, _, v, *_ in _claimed(800, 5):
        by_count.setdefault(g, []).append(v)
    majority = sum(max(sorted(set(v)), key=v.count).startswith("t") for v in by_count.values()) / len(by_count)
    right = sum(r.value.startswith("t") for r in kept) / len(kept)
    assert right > 0.9 and right > majority


@pytest.mark.parametrize("local", [20_000, 0])
def test_trust_equals_a_plain_restatement(frame, monkeypatch, local):
    """Claim by claim, without masks and profiles; sums on the driver and by Spark."""
    monkeypatch.setattr(survivors, "LOCAL_PROFILES", local)
    rows = _claimed(60, 9)
    fused = _fuse(frame(rows, CLAIMS), policy="posterior", min_records=1)
    names = ["one", "two", "three", "four"]
    items = {}
    for g, _, v, s, *_ in rows:
        items.setdefault(g, {}).setdefault(v, set()).add(names.index(s))
    prior = [0.9, 0.8, 0.7, 0.6]
    accuracy, belief = prior, None
    for step in range(fused.trust.rounds + 1):  # step 0 judges copying before the first vote
        if step:
            belief = {}
            for g, said in items.items():
                weight = {}
                for v, who in said.items():
                    order = sorted(who, key=lambda s: (round(sum(copies[s][t] - copies[t][s] for t in who), 9), -accuracy[s], s))  # noqa: B023
                    weight[v] = math.exp(sum(math.log(10 * accuracy[s] / (1 - accuracy[s])) * math.prod(1 - share[s][t] * (copies[s][t] + copies[t][s]) for t in order[:i]) for i, s in enumerate(order)))
                belief |= {(g, v): w / (sum(weight.values()) + 11 - len(weight)) for v, w in weight.items()}
            fresh = []
            for s in range(4):
                mine = [belief[g, v] for g, said in items.items() for v, who in said.items() if s in who]
                fresh.append(min(0.99, (sum(mine) + 10 * prior[s]) / (len(mine) + 10)))
            accuracy = fresh
        copies, share = ([[0.0] * 4 for _ in range(4)] for _ in range(2))
        for s in range(4):
            for t in range(s):
                common = [(g, v) for g, said in items.items() for v, who in said.items() if {s, t} <= who]
                met = sum(any(s in w for w in said.values()) and any(t in w for w in said.values()) for said in items.values())
                alone = {x: [belief[g, v] for g, said in items.items() for v, who in said.items() if x in who and y not in who] for x, y in ((s, t), (t, s))} if belief else {}
                own = {x: min(0.99, max(0.01, (sum(alone[x]) + 10 * accuracy[x]) / (len(alone[x]) + 10))) if belief else accuracy[x] for x in (s, t)}
                true = sum(belief[c] for c in common) if belief else 0.0
                copies[s][t], copies[t][s], share[s][t] = survivors.copying(true, len(common) - true, met - len(common), accuracy[s], accuracy[t], own[s], own[t], 10, 0.8, bool(belief))
                share[t][s] = share[s][t]
                if belief and min(map(len, alone.values())) < 10:
                    copies[s][t] = copies[t][s] = (copies[s][t] + copies[t][s]) / 2
    assert fused.trust.settled and fused.trust.rounds <= 10  # none of them halved
    assert fused.trust.accuracy == pytest.approx(accuracy, abs=1e-9)
    assert sum(fused.trust.dependence, []) == pytest.approx([copies[s][t] + copies[t][s] for s in range(4) for t in range(4)], abs=1e-9)
    posterior = {(r.g, r.value): r.posterior for r in fused.survivors.collect()}
    assert all(abs(p - belief[k]) < 0.02 for k, p in posterior.items())


def test_more_sources_than_can_be_told_apart_are_an_error(frame):
    with pytest.raises(ValueError, match="at most 11"):
        survivors.fuse_fields(frame([], CLAIMS), ["g"], "id", {"text": F.col("text")}, "src", [f"s{i}" for i in range(12)], [F.col("rank")])


def test_survivors_of_an_empty_table(frame):
    assert _fuse(frame([], CLAIMS), cut_off_field="text").survivors.count() == 0


# Tokens ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return tokens.codec(tokens.read_vocabulary())


def test_fragments_give_the_same_ids_as_the_whole(codec):
    random.seed(13)
    alphabet = ["a", "don't", " ", "  ", "\n", "é", "主要终点", "!!", "…", "'s", "’", "9", "١٢", " ", "x" * 40, "--", "\U0001f600", "ß", "<|endoftext|>", "́", "　", "'", "ll"]
    for _ in range(600):
        text = "".join(random.choice(alphabet) for _ in range(random.randrange(1, 120)))
        assert codec.encode(text, 8) == codec.encoding.encode_ordinary(text)
    long = "主要终点为视网膜厚度" * 3000 + "Zażółć" * 500
    assert len(codec.cuts(long.encode(), 512)) > 20
    assert codec.encode(long, 512) == codec.encoding.encode_ordinary(long)


@pytest.mark.parametrize("text", ["The participants were followed for 12 weeks. ", "主要终点为视网膜厚度，", "Zażółć gęślą jaźń; ", "a\n\n  b\t c\r\n"])
def test_texts_of_any_script_are_cut_by_bytes_on_both_sides_of_the_bound(codec, text):
    unit = len(text.encode())
    for size in (tokens.FRAGMENT - 2 * unit, tokens.FRAGMENT, 3 * tokens.FRAGMENT, 12_288):
        whole = text * (size // unit)
        data = whole.encode()
        cuts = codec.cuts(data, tokens.FRAGMENT)
        assert len(cuts) >= len(data) // (tokens.FRAGMENT + 2 * unit) - 1 and (len(data) > tokens.FRAGMENT or not cuts)
        assert all(b - a >= tokens.FRAGMENT for a, b in zip([0, *cuts], cuts, strict=False))
        assert codec.encode(whole) == codec.encoding.encode_ordinary(whole)


def test_ids_agree_with_the_other_library(codec):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{tokens.DEFAULT_FOLDER}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in ("Don't stop — 57 µg/dL.\r\n\tDone  ", "主要终点, and <|endoftext|>", "   "):
        assert codec.encode(text) == other.encode(text, add_special_tokens=False).ids


def test_encode_corpus_keeps_every_row(frame):
    rows = [(1, "Hello world"), (2, ""), (3, None), (None, "Hello world"), (1, "Hello world")]
    out = tokens.encode_corpus(frame(rows, "k long, text string"), "k", "text").collect()
    assert sorted((r.k or 0, r.ids) for r in out) == sorted([(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, []), (0, [15496, 995])])


# Packing --------------------------------------------------------------------------------------

ITEMS = "k long, n long, s string"


def test_packing_keeps_items_whole_and_wastes_little(frame):
    random.seed(17)
    rows = [(i, random.choice([5, 30, 80, 99, 100, 250, 0]), random.choice(["a"] * 4 + ["b", None])) for i in range(4000)]
    out = packing.pack(frame(rows, ITEMS), "k", "n", F.col("s"), 100, shard_size=20_000, window=16).collect()
    filled, whole = {}, {}
    for r in out:
        whole[r.k] = whole.get(r.k, 0) + r.size
        if r.container_id:
            filled[r.container_id] = filled.get(r.container_id, 0) + r.size
    assert whole == {k: n for k, n, _ in rows}
    assert max(filled.values()) <= 100
    assert {r.n_pieces for r in out if r.size and dict((k, n) for k, n, _ in rows)[r.k] <= 100} == {1}
    assert len(filled) <= 1.05 * sum(filled.values()) / 100
    assert all((r.container_id is None) == (r.size == 0) for r in out)


def test_packing_holds_the_mixture_window_by_window():
    import numpy as np

    random.seed(19)
    sizes = np.array([random.randrange(1, 60) for _ in range(6000)])
    sources = np.array([random.choice([1, 1, 1, 2]) for _ in sizes])
    total = sizes.sum()
    shares = {s: float(sizes[sources == s].sum() / total) for s in (1, 2)}
    slots = packing.drain(sizes, sources, shares, {1: 0.0, 2: 0.0}, 100, 64)
    for start in range(0, int(slots.max()) - 128, 128):
        inside = (slots >= start) & (slots < start + 128)
        assert abs(sizes[inside & (sources == 2)].sum() / sizes[inside].sum() - shares[2]) < 0.03


def test_packing_with_targets_that_leave_a_source_out(frame):
    rows = [(i, 7, "a" if i % 3 else "b") for i in range(300)]
    out = packing.pack(frame(rows, ITEMS), "k", "n", F.col("s"), 20, targets={"a": 1.0}).collect()
    assert len(out) == 300 and all(r.container_id for r in out)


def test_packing_to_targets_holds_them_and_marks_the_surplus(frame):
    """Three quarters of the sizes are of one source, half of each is asked for: half of the corpus is in the mixture."""
    random.seed(23)
    rows = [(i, random.randrange(1, 60), "a" if i % 4 else "b") for i in range(24_000)] + [(-1, 950, "b"), (-2, None, "a"), (-3, 20, None), (-4, 20, "c")]
    placed = packing.pack(frame(rows, ITEMS), "k", "n", F.col("s"), 100, targets={"a": 1.0, "b": 1.0, "unknown": 3.0}, shard_size=60_000, window=32)
    kept = placed.collect()
    whole = {}
    for r in kept:
        whole[r.k] = whole.get(r.k, 0) + r.size
    assert whole == {k: n or 0 for k, n, _ in rows}
    inside = [r for r in kept if r.in_mixture]
    share = sum(r.size for r in inside if r.source == "b") / sum(r.size for r in inside)
    assert abs(share - 0.5) < 0.01 and {r.source for r in inside} == {"a", "b"}
    assert sum(r.size for r in inside) > 0.97 * 2 * sum(r.size for r in kept if r.source == "b")
    assert not {r.window_id for r in inside} & {r.window_id for r in kept if r.in_mixture is False}
    report = {r.in_mixture: r for r in packing.mixture_report(placed, 100).collect()}
    assert report[True].max_error < 0.05 and report[True].fill > 0.98 and report[False].fill > 0.98
    by_window = {}
    for r in inside:
        window = by_window.setdefault(r.window_id, {"a": 0, "b": 0})
        window[r.source] += r.size
    errors = {w: abs(v["b"] / (v["a"] + v["b"]) - share) for w, v in by_window.items()}
    sizes = {w: sum(v.values()) for w, v in by_window.items()}
    assert report[True].n_windows == len(errors)
    assert report[True].mean_error == pytest.approx(sum(errors[w] * sizes[w] for w in errors) / sum(sizes.values()))
    assert report[True].max_error == pytest.approx(max(errors[w] for w in errors if sizes[w] >= 0.9 * max(sizes.values())))


def test_packing_of_an_empty_table(frame):
    assert packing.pack(frame([], ITEMS), "k", "n", F.col("s"), 100).count() == 0
    assert packing.mixture_report(packing.pack(frame([], ITEMS), "k", "n", F.col("s"), 100, targets={"a": 1.0}), 100).count() == 0


# Subjects -------------------------------------------------------------------------------------


def test_subjects_of_texts(frame):
    rows = [
        (1, "Confirmed heart failure. Mean ejection fraction changed. Unlike in dengue fever, no titration is planned."),
        (2, "BEFORE CHEMOTHE-\nRAPY the melanoma grew; an insulin pump was fitted for <b>type&nbsp;2 diabetes</b>. HbA1c rose."),
        (3, "各次访视记录抗体滴度。其亲属曾患溃疡性结肠炎。"), (4, None), (5, ""), (6, " \n"), (7, "66.02\t68.76"), (8, "The file is here."), (9, "atrial fibirllation noted"), (10, "Geprüft wird ulvotuzimab."), (11, "Geprüft wird Trastuzumab."),
    ]
    out = subjects.assign_subjects(frame(rows, "k long, text string"), "k", "text").collect()
    got = {}
    for r in out:
        got.setdefault(r.k, set()).add(r.subject_code)
    assert got == {1: {"cardiology"}, 2: {"oncology", "endocrinology"}, 3: {"infectious_disease"}, 9: {"cardiology"}, 11: {"oncology"}}


def test_words_inside_words_are_no_mention():
    match = subjects.matcher(tuple(subjects.read_terms()))
    assert match.mentions("The scancerous hivernal asthmalike text")[1] == {}


SCORES = "k long, subject_code string, n_mentions int, share double, density double"


def test_calibration_finds_a_separating_share(frame):
    """Many mentions part at .3, single ones at .6, far from the values believed beforehand."""
    rows = [(i, "a", 3, 0.4 + i % 5 / 10, 1.0) for i in range(200)] + [(i, "b", 3, 0.05 + i % 20 / 100, 1.0) for i in range(200)]
    rows += [(i, "c", 1, 0.7 if i % 2 else 0.5, 1.0) for i in range(200)]
    labels = frame([(i, "a") for i in range(200)] + [(i, "c") for i in range(1, 200, 2)], "k long, subject_code string")
    found = subjects.calibrate(frame(rows, SCORES), labels, "k")
    assert 0.22 <= found.share <= 0.4 and 0.48 < found.share_single <= 0.7
    kept = {(r.k, r.subject_code) for r in subjects.above(frame(rows, SCORES), found).collect()}
    assert len(kept ^ {(r.k, r.subject_code) for r in labels.collect()}) < 12


def test_calibration_keeps_what_is_believed_without_evidence(frame):
    rows = frame([(1, "a", 2, 0.9, 1.0), (1, "b", 1, 0.06, 1.0)], SCORES)
    assert subjects.calibrate(rows, frame([], "k long, subject_code string"), "k") == subjects.Thresholds()
    assert subjects.calibrate(rows, frame([(1, "a"), (None, "b")], "k long, subject_code string"), "k") == subjects.Thresholds()


def test_a_cue_reaches_its_whole_sentence_and_no_further(frame):
    filler = "of a kind seen in many clinics and reported again and again over the years " * 4
    long_tag = f"<p class='{filler}'>"
    rows = [(6, f"{long_tag}Dengue{long_tag} fever, p < 0.05 and q > 3"), (1, f"Unlike {filler} in dengue fever."), (2, f"Dengue fever is {filler} unlike others."), (3, "Unlike before.\n\nDengue fever"), (4, "It is unlike that. Dengue fever here"), (5, "Not apparently dengue fever")]
    out = subjects.assign_subjects(frame(rows, "k long, text string"), "k", "text").collect()
    assert {r.k for r in out} == {3, 4, 5, 6}


def test_terms_are_graded_and_open_where_they_say(frame):
    terms = subjects.read_terms()
    assert {t.weight for t in terms} == {1.0, 0.6, 0.3}
    match = subjects.matcher((subjects.parse_term("stent*", "a", 1.0), subjects.parse_term("*thyroid*", "b", 1.0), subjects.parse_term("eye", "c", 1.0)))
    assert match.mentions("existent stents, hyperthyroidism; eyes and eyed")[1] == {0: 1, 1: 1, 2: 1}


def test_subjects_of_an_empty_table(frame):
    assert subjects.assign_subjects(frame([], "k long, text string"), "k", "text").count() == 0


# Clashing names and very long texts -----------------------------------------------------------

CLASHING = ("position", "__part", "__count", "ids", "n_tokens", "__text", "size", "source", "shard", "slot", "piece_no", "n_pieces", "mask", "rep", "fields", "value", "flat", "field_name", "mentions", "n_words", "share", "subject_code")


def test_extra_columns_with_clashing_names_change_nothing(frame):
    rows = [(1, "g", "heart failure and insulin", 0.5, 7, 2), (2, "g", "heart failure", 0.25, 3, 1), (3, None, None, None, None, None)]
    df = frame(rows, "k long, g string, text string, s double, n long, rank int")
    wide = df.select("*", *[F.lit("x").alias(c) for c in CLASHING])

    def fused(d):
        return survivors.fuse_fields(d, ["g"], "k", {"text": F.col("text")}, "g", ["a"], [F.col("rank")], cut_off_field="text").survivors

    for run in (
        lambda d: top_n.top_n_per_group(d, ["g"], "s", ["k"], 2),
        lambda d: splitting.split_oversized(d, ["k"], "text", "n", "rank"),
        lambda d: tokens.encode_corpus(d, "k", "text"),
        lambda d: packing.pack(d, "k", "n", F.col("g"), 4),
        lambda d: subjects.assign_subjects(d, "k", "text"),
        fused,
    ):
        plain, clashing = run(df), run(wide)
        assert plain.columns == clashing.columns
        drop = [c for c in ("container_id", "window_id") if c in plain.columns]
        assert sorted(map(str, plain.drop(*drop).collect())) == sorted(map(str, clashing.drop(*drop).collect()))


def test_very_long_texts(frame):
    long = ("Confirmed heart failure in 12 people; " * 40_000) + "x" * 100_000
    df = frame([(1, long, 1000, 80)], "k long, text string, lim int, lap int", 1)
    pieces = splitting.split_oversized(df, ["k"], "text", "lim", "lap").agg(F.max("n_pieces").alias("n"), F.max(F.length("piece_text")).alias("m"), F.count(F.lit(1)).alias("c")).first()
    assert pieces.m <= 1000 and pieces.n == pieces.c > 1500
    ids = tokens.encode_corpus(df, "k", "text").first().ids
    assert ids == tokens.codec(tokens.read_vocabulary()).encoding.encode_ordinary(long)
    assert [r.subject_code for r in subjects.assign_subjects(df, "k", "text").collect()] == ["cardiology"]
