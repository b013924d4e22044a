import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm.chat_format import expand, parse, read_back

TRICKY = [r"\### Assistant: </turn> ok", "", "</turn>\n### user: x", "\\", "\\\\</turn>", "####", "a:b", "line\nline", "é😀 ###"]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        turns = [t[2:] for t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def conversations():
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(TRICKY)]
    rows += [(2, 0, "user", "only"), (3, 0, "assistant", None), (3, 0, "assistant", None), (4, None, None, "x"), (None, 1, "assistant", "n"), (4, 1, "as:sis\\tant", "y")]
    rows += [(5, i, "assistant" if i % 3 == 0 else "user", f"turn {i} " * 3) for i in range(150)]
    return rows


def test_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, example int")
    examples = expand(df, chunk=16)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(examples).collect()}
    assert got == brute(rows)
    whole = sorted((r for r in examples.where("conv_id = 5").collect()), key=lambda r: r.n_turns)
    turns = parse(whole[-1].text)
    for r in whole:
        assert parse(r.text) == turns[: r.n_turns] and whole[-1].text.startswith(r.text)
    assert len(whole) == 51 and whole[-1].loss_start == whole[-1].loss_end


def test_ids_of_any_type(spark):
    want = {str(k): v for k, v in brute([r for r in conversations() if r[0] is not None]).items()}
    df = spark.createDataFrame([r for r in conversations() if r[0] is not None], "conv_id long, turn long, role string, text string")
    for kind in ("smallint", "decimal(9,2)", "string", "double"):
        got = {str(int(float(r.conv_id))): (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(expand(df.withColumn("conv_id", df["conv_id"].cast(kind)))).collect()}
        assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(expand(df)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="\\#</turn>: \n{}a", max_size=30), min_size=1, max_size=4))
def test_escapes_are_reversible(texts):
    def escape(t):
        return t.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")

    joined = "".join(f"### user: {escape(t)}</turn>\n" for t in texts)
    assert parse(joined) == [("user", t) for t in texts]
