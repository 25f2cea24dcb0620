"""Formatted conversations, read back."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from quarry.llm.chat import TURNS, assemble, format_conversations, read_back, turns_of, unescape

PIECES = ["</s>", "<s>", "[INST]", " [/INST]", "[SYS] ", "[/SYS]", "[ROLE]", "\\", "<", "[", "/s>", "\n", "é", "𝒳", "word ", "<\\/s>", "[\\\\INST]", "n"]


def made(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 7)))


def test_assembly_round_trip():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 12)
        roles = [rng.choice([*TURNS, "tool", "", made(rng)]) for _ in range(n)]
        texts = [made(rng) for _ in range(n)]
        if rng.random() < 0.1:
            texts[0] = texts[0] + "é<s>" * 40_000
        first = np.array([0, *sorted(rng.sample(range(1, n), rng.randint(0, n - 1))), n])
        formatted, low, high = (x.to_pylist() for x in assemble(pa.array(roles), pa.array(texts), first))
        for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            assert list(turns_of(formatted[k])) == list(zip(roles[a:b], texts[a:b], strict=True))
            learned = [unescape(formatted[k][x:y]) for x, y in zip(low[k], high[k], strict=True)]
            assert learned == [t for r, t in zip(roles[a:b], texts[a:b], strict=True) if r == "assistant"]


def test_plain_turns_read_as_they_should():
    formatted, low, high = assemble(pa.array(["system", "user", "assistant", "tool"]), pa.array(["Be kind.", "Hi </s>", "Hello", "42"]), np.array([0, 4]))
    assert formatted.to_pylist() == ["[SYS] Be kind. [/SYS][INST] Hi <\\/s> [/INST]<s>Hello</s>[ROLE] tool\n42 [/ROLE]"]
    assert formatted[0].as_py()[low[0][0].as_py() : high[0][0].as_py()] == "Hello"


def want(rows):
    out, groups = [], {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in groups.items():
        turns.sort()
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_conversations(spark):
    rng = random.Random(5)
    rows = [(conv, turn, rng.choice(["user", "assistant", "system", "critic"]), made(rng)) for conv in range(80) for turn in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "still none"), (200, None, "assistant", "first"), (200, 1, None, None), (200, 1, "assistant", "b"), (200, 1, "assistant", "b"), (200, 1, "assistant", "a"), (201, 0, "assistant", "")]
    rows += [(300, k // 3, "assistant" if k % 2 else "user", f"turn {k} " * 20) for k in range(2000)] + [(301, 0, "user", "same text") for _ in range(3000)] + [(303, k, "user", "") for k in range(1000)] + [(302, 0, "assistant", "long " * 30_000), (302, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as whole", "3 as formatted").repartition(6)
    for part_bytes in (1 << 20, 5000):
        parts = format_conversations(df, part_bytes).cache()
        assert sorted((tuple(r)[:5] for r in read_back(parts).collect()), key=repr) == want(rows)
        sizes = parts.selectExpr("conv_id", "n_turns", "length(formatted) n").collect()
        assert sum(r["n_turns"] for r in sizes) == len(rows)
        if part_bytes == 5000:
            assert max(r["n"] for r in sizes if r["conv_id"] != 302) < 7000
            of_hot = parts.where("conv_id = 301").selectExpr("part >> 40 as task").distinct().count()
            assert of_hot > 1  # equal rows of one turn are dealt out as well
    assert read_back(format_conversations(df.limit(0))).count() == 0
