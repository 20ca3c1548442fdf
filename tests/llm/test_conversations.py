"""The three operators on conversations against plain versions, on odd rows and on whole tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import conversation_repair as repair
from loomspan.llm import queries
from loomspan.llm.chat_format import QUESTIONS_AND_ANSWERS, SEGMENTS, Template, _Reader, chat_digests, format_chat, in_order, read_back
from loomspan.llm.prefix_trie import conversation_paths, prefix_trie

CONVERSATIONS = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows):
    """conv_id -> its rows by turn, role and text, nulls first."""
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: [(v is not None, v if v is not None else 0) for v in r[:2]] + [r[2] or "", r[3] or ""]):
        out.setdefault(c, []).append((t, r or "", x or ""))
    return out


def odd_rows(seed: int, n: int = 300):
    r = random.Random(seed)
    texts = ["Yes.", "No", "", " \t", "Why? ", "\\", "### User: x", "</turn>\n", "a</turn", "\\</turn>", "ü ß é!", None, "Yes.", "long " * 2000 + "end."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "Role: </role> "]
    rows = [(r.choice([*range(0, 40), 100, 101, 105, 199, -3, -150, None]), r.choice([None, *range(9)]), r.choice(roles), r.choice(texts)) for _ in range(n)]
    rows += [(7, k, ("user", "assistant")[k % 2], f"turn {k % 50}.") for k in range(3000)]  # long, over many Arrow batches and chunks
    return rows + rows[:40] + [(c, k, ("user", "assistant")[k % 2], f"same {k}.") for c in range(1000, 1300) for k in range(4)]


def frame(spark, rows):
    from pyspark.sql import functions as F

    plain = spark.createDataFrame(rows, CONVERSATIONS)
    return plain.repartition(5).withColumns({c: F.lit(1) for c in ("segment", "at", "chunk", "path", "w", "h", "loss", "state", "n")})


@pytest.fixture(scope="module")
def rows():
    return odd_rows(1)


# formatting


def test_formatted_conversations_read_back(spark, rows):
    segments = format_chat(frame(spark, rows))
    assert segments.columns == [x.split()[0] for x in SEGMENTS.split(", ")]
    want = ordered(rows)
    got = {}
    for r in read_back(segments).collect():
        got.setdefault(r["conv_id"], []).append((r["nth"], r["role"], r["text"]))
    assert {c: sorted(x) for c, x in got.items()} == {c: [(k, a, b) for k, (_, a, b) in enumerate(x)] for c, x in want.items()}
    stored = spark.createDataFrame(sorted(segments.collect(), key=lambda r: r["segment"]), SEGMENTS)
    digests = {r["conv_id"]: r for r in chat_digests(in_order(stored)).collect()}
    machine = QUESTIONS_AND_ANSWERS
    for c, turns in want.items():
        learned = "".join(x for _, a, x in turns if a == "assistant")
        state, legal = machine.start, True
        for _, a, _ in turns:
            legal, state = legal and a in machine.moves[state], machine.moves[state].get(a, state)
        d = digests[c]
        assert (d["n_turns"], d["turns_sha256"], d["loss_chars"], d["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{x}\n" for _, a, x in turns)), len(learned), sha(learned))
        assert d["legal"] == (legal and state in machine.final)
    assert len(digests) == len(want)


def test_segments_follow_template_and_machine(spark):
    got = format_chat(frame(spark, [(1, 0, "system", "Be."), (1, 1, "user", "Say </turn>"), (1, 2, "assistant", "So."), (1, 3, "assistant", "More.")])).collect()
    assert [(r["text"], r["loss"], r["legal"]) for r in got] == [
        ("### System: Be.</turn>\n", False, True), ("### User: Say \\</turn></turn>\n", False, True), ("### Assistant: ", False, True), ("So.", True, True), ("</turn>\n", False, True),
        ("### Assistant: ", False, False), ("More.", True, False), ("</turn>\n", False, False),
    ]
    assert format_chat(frame(spark, [(1, 0, "user", "x")]).limit(0)).count() == 0


PIECES = st.lists(st.sampled_from(["\\", "#", "### ", "### User: ", "### Assistant: ", "### Role: ", "</", "</turn>", "</role>", "\n", "x", "turn>", " "]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), PIECES), PIECES), max_size=4))
def test_any_text_reads_back(turns):
    import pyarrow as pa

    t = QUESTIONS_AND_ANSWERS
    whole = "".join(t.opening(r) + t.escaped(pa.array([x]))[0].as_py() + t.closer + t.between for r, x in turns)
    for cut in (len(whole) + 1, 1, 3):
        reader = _Reader(t)
        assert [x for k in range(0, len(whole), cut) for x in reader.turns(whole[k : k + cut])] == turns
        reader.close()


def test_templates_that_could_be_misread_are_refused():
    good = {"openers": {"user": "<u>"}, "other": ("<o>", "</o>"), "closer": "</t>", "moves": {}, "start": "s", "final": frozenset(), "learned": frozenset()}
    Template(**good)
    for change in ({"closer": ""}, {"closer": "a\\"}, {"closer": "o>"}, {"other": ("<u>x", "</o>")}, {"escape": ""}):
        with pytest.raises(ValueError):
            Template(**good | change)


# trie


def plain_trie(paths):
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    kids = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        below = kids.get(key, [])
        leaves[key] = sum(leaves[k] for k in below) or 1
        saved[key] = sum(saved[k] for k in below) + (len(members[key]) - 1) * (len(key[-1][1]) if key else 0)
    ends = {key: [c for c in sorted(m) if len(paths[c]) == len(key)] for key, m in members.items()}
    return sorted(
        (min(m), len(key), min(members[key[:-1]]) if key else -1, len(m), len(kids.get(key, [])), leaves[key], saved[key], sha(",".join(map(str, ends[key])))) for key, m in members.items()
    )


def trie_rows(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


@pytest.mark.parametrize("limit", [512, 40, 1])
def test_trie(spark, rows, limit):
    paths = {c: [(a, x) for _, a, x in turns] for c, turns in ordered(rows).items() if c is not None}
    by_digest = lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).digest())
    paths = {c: [(a, x) for _, a, x in sorted(turns, key=by_digest)] for c, turns in ordered(rows).items() if c is not None and c != 7} | {7: paths[7][:60]}
    kept = [r for r in rows if r[0] != 7] + [(7, k, *x) for k, x in enumerate(paths[7])]
    assert trie_rows(prefix_trie(conversation_paths(frame(spark, kept)), limit)) == plain_trie(paths)


def test_trie_passes_over_shared_turns_and_counts_empty_paths(spark):
    shared = [("user", f"u{k}") for k in range(300)]
    paths = {c: [*shared, ("user", f"end {c % 20}")] + [("assistant", "x")] * (c % 3) for c in range(60)} | {90: [], 91: [], 92: shared, 93: shared[:7]}
    rows = [(c, k, *x) for c, path in paths.items() for k, x in enumerate(path)]
    made = conversation_paths(frame(spark, rows)).unionByName(conversation_paths(frame(spark, [(90, 0, "a", "b"), (91, 0, "a", "b")])).selectExpr("conv_id", "slice(path, 1, 0) AS path"))
    assert trie_rows(prefix_trie(made, 100)) == plain_trie(paths)
    assert prefix_trie(made.limit(0)).count() == 0


def test_rebuilt_trie_of_whole_table(spark):
    source = ordered([tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    paths = {}
    for c, turns in source.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = [(a, x) for _, a, x in source.get(c - c % 100, [])[:h] + turns[h:]]
    assert trie_rows(queries.op12_prefix_trie(spark, SF)) == plain_trie(paths)


# repair


def plain_damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        out += [(c, t, "user" if fate == 4 else r, x)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def faults_of(turns):
    seen, out = set(), []
    for _, r, x in turns:
        visible = re.sub(r"[\x20\x09-\x0D]+\Z", "", x)
        out.append("b" if not re.search(r"[^\x20\x09-\x0D]", x) else "d" if (r, x) in seen else "" if visible[-1] in ".!?" else "t")
        seen.add((r, x))
    return out


def plain_repair(turns, faults):
    """(cost, audit, repaired turns) by walking all states turn by turn, with whole results instead of matrices."""

    def inserted(best):
        for _ in range(3):
            for s in list(best):
                role = "assistant" if s == 2 else "user"
                to = 3 if s == 2 else 2
                cost, audit, done = best[s]
                best[to] = min(best.get(to, (10**9,)), (cost + 5, audit + "I", [*done, (role, "")]))
        return best

    move = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, "", [])}
    for (_, r, x), fault in zip(turns, faults, strict=True):
        after = {}
        for s, (cost, audit, done) in inserted(best).items():
            ways = [(s, cost + 2, audit + "D", done)]
            if fault not in ("b", "d"):
                more, role = 5 * (fault == "t"), "assistant" if s == 2 else "user"
                ways.append((3 if s == 2 else 2, cost + 1 + more, audit + "R", [*done, (role, x)]))
                if (s, r[:1]) in move:
                    ways.append((move[s, r[:1]], cost + more, audit + "K", [*done, (r, x)]))
            for to, *way in ways:
                after[to] = min(after.get(to, (10**9,)), tuple(way))
        best = after
    best = inserted(best)
    return min(best[s] for s in (0, 3) if s in best)


def plain_report(rows, originals):
    by = ordered(rows)
    out = {}
    for c in originals:
        turns = by.get(c, [])
        faults = faults_of(turns)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, done = plain_repair(turns, faults)
        out[c] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in done)))
    return out


def report_rows(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


@pytest.mark.parametrize("bits", [9, 3])
def test_repair_of_odd_rows(spark, rows, tmp_path, bits, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    monkeypatch.setattr(repair, "FAN", 4)
    rows = [r for r in rows if r[0] != 7] + [(7, *x) for x in [(k, r, t) for k, (r, t) in enumerate((("user", "assistant", "user", "tool")[k % 4], f"turn {k % 90}" + "." * (k % 7 > 0)) for k in range(700))]]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = report_rows(queries.op13_conversation_repair(spark, str(tmp_path)))
    assert got == plain_report(plain_damage(rows), {r[0] for r in rows})


def test_repair_of_whole_table_and_of_nothing(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert report_rows(queries.op13_conversation_repair(spark, SF)) == plain_report(plain_damage(rows), {r[0] for r in rows})
    frame(spark, rows).limit(0).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_conversation_repair(spark, str(tmp_path)).count() == 0
    assert queries.op12_prefix_trie(spark, str(tmp_path)).count() == 0
    assert [r["conv_id"] for r in queries.op11_chat_formatting(spark, str(tmp_path)).collect()] == [-7]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("sua t"), st.sampled_from(["", "b", "d", "t"])), max_size=7), st.integers(0, 7))
def test_products_do_not_depend_on_grouping(turns, cut):
    matrices = [repair.turn_matrix(*x) for x in turns]
    whole = repair.product(matrices)
    assert whole == repair.times(repair.product(matrices[:cut]), repair.product(matrices[cut:])) == repair.product([repair.IDENTITY, *matrices])
    best = min(e for e in (repair.times(whole, repair.INSERTS)[j] for j in repair.FINAL) if e is not None)
    assert best == plain_repair([(0, r, "x") for r, _ in turns], [f for _, f in turns])[:2]
