"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the text of all preceding turns, its context, and then of itself, the
target; only the target's text is trained on. Turns after a conversation's last reply form an example without target,
with all turns before them. Examples are spelled out, so a conversation of n turns gives n / 2 texts of n / 2 turns each
at the mean: the output grows with the square of a conversation's length, as the method has it.

An example of at most `most_turns` turns and 4 million characters is one row. A longer one goes on in further rows, in
order and cut between turns, so that no row is larger than that or than a single turn; expand() joins them.

Template of a turn: <s>[INST:role]text[/INST]</s> and a line feed. In roles and texts &, < and [ are written as &amp;,
&lt; and &#91;, so no control string, of this template or another's, is left in them; unescape() is exact.

Cases: null texts and roles count as empty; null turns come first; turns that tie are ordered by role and text, and
repeated rows each count; a null conversation id is a conversation; an empty table gives no rows; other columns are
ignored. One conversation's rows stream in order through one task, which keeps the row being built and, for the contexts
to come, the turns so far: up to 64 MB of them in memory, beyond that in a file of its own that goes with it."""

from __future__ import annotations

import hashlib
import re
import tempfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN = re.compile(r"<s>\[INST:([^\]<]*)\]([^<\[]*)\[/INST\]</s>\n")
EXAMPLE_DDL = "conv_id long, example long, part long, text string, n_turns long, known_chars long, loss_start long, loss_end long"
_NAMES = ["conv_id", "example", "part", "text", "n_turns", "known_chars", "loss_start", "loss_end"]


def escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;")


def unescape(s: str) -> str:
    return s.replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&")


def escape_role(s: str) -> str:
    return escape(s).replace("]", "&#93;")


def unescape_role(s: str) -> str:
    return unescape(s.replace("&#93;", "]"))


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The turn, and where its text begins."""
    head = f"<s>[INST:{escape_role(role)}]"
    return f"{head}{escape(text)}[/INST]</s>\n", len(head)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; anything that is not a turn is an error."""
    out, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def _batches(rows, names, schema, most_chars=4 << 20):
    part, size = [], 0
    for r in rows:
        part.append(r)
        size += 64 + sum(len(x) for x in r if isinstance(x, str))
        if size >= most_chars or len(part) >= 5000:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in part], schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in part], schema)


class _Prefix:
    """The formatted turns of a conversation so far, in parts of bounded size. The parts that are full lie in a file, in
    memory while that is small; the last one is a string."""

    def __init__(self, most_turns: int, most_chars: int = 4 << 20, in_memory: int = 64 << 20):
        self.most_turns, self.most_chars, self.in_memory = most_turns, most_chars, in_memory
        self.file, self.full = None, []  # of each full part: bytes, turns up to its end
        self.last, self.chars, self.turns, self.begin = "", 0, 0, 0  # begin: turns before the last part

    def add(self, turn: str) -> None:
        if self.turns > self.begin and (self.turns - self.begin >= self.most_turns or len(self.last) + len(turn) > self.most_chars):
            self.file = self.file or tempfile.SpooledTemporaryFile(self.in_memory)  # noqa: SIM115
            self.file.seek(0, 2)
            self.full.append((self.file.write(self.last.encode()), self.turns))
            self.last, self.begin = "", self.turns
        self.last += turn
        self.chars += len(turn)
        self.turns += 1

    def parts(self):
        """(text, turns up to its end) of each part; all turns so far, in order."""
        if self.full:
            self.file.seek(0)
            for size, upto in self.full:
                yield self.file.read(size).decode(), upto
        yield self.last, self.turns

    def close(self) -> None:
        if self.file:
            self.file.close()


def _examples(rows, most_turns: int):
    """rows: (conv, role, text) in order; one conversation after another."""
    now, prefix = None, None
    example = known_chars = known_turns = 0  # known: what the conversation's examples so far hold

    def spelled(loss_start=None, loss_end=None):
        begin = 0
        for part, (text, upto) in enumerate(prefix.parts()):
            yield now, example, part, text, max(0, upto - max(begin, known_turns)), known_chars, loss_start, loss_end
            begin = upto

    for conv, role, text in rows:
        if prefix is None or conv != now:
            if prefix:
                if prefix.turns > known_turns:
                    yield from spelled()
                prefix.close()
            now, prefix = conv, _Prefix(most_turns)
            example = known_chars = known_turns = 0
        turn, head = format_turn(role, text)
        begin = prefix.chars + head
        prefix.add(turn)
        if role == "assistant":
            yield from spelled(begin, begin + len(escape(text)))
            example, known_chars, known_turns = example + 1, prefix.chars, prefix.turns
    if prefix:
        if prefix.turns > known_turns:
            yield from spelled()
        prefix.close()


def prefix_targets(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_turns: int = 256) -> DataFrame:
    """Examples, each with its whole context: conv_id, example, part, text, n_turns, known_chars, loss_start, loss_end.

    Parts of an example, from 0, together are its text. loss_start and loss_end count characters from the beginning of
    the example and are the same in all its parts; null in an example without target. The first known_chars characters
    are those of the conversation's example before; n_turns counts the turns of a part that lie beyond them."""
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("n_turns", pa.int64()), ("known_chars", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _batches(_examples(rows, most_turns), _NAMES, schema)

    own = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("n"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return own.repartition("c").sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t").mapInArrow(run, EXAMPLE_DDL)


def expand(examples: DataFrame) -> DataFrame:
    """Each example as one text, its parts joined, from rows that lie in order: conv_id, example, text, loss_start, loss_end.

    A text must be short enough for a row."""
    names = ["conv_id", "example", "text", "loss_start", "loss_end"]
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def joined(rows):
        last, parts = None, []
        for conv, example, part, text, _, _, begin, end in rows:
            if part == 0 and parts:
                yield *last[:2], "".join(parts), *last[2:]
                parts = []
            parts.append(text)
            last = conv, example, begin, end
        if parts:
            yield *last[:2], "".join(parts), *last[2:]

    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _batches(joined(rows), names, schema)

    return examples.mapInArrow(run, "conv_id long, example long, text string, loss_start long, loss_end long")


_DIGEST = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _digests(rows):
    """rows: text as a buffer of UTF-8, and its number of characters after it.

    Each example's context must be the conversation's text before it, byte by byte (told by SHA-256), so what it adds is
    read once; its length and its target are its own."""
    now, state, seen = None, None, None  # seen: of the whole example before
    at, whole, open_, example, part = 0, None, False, None, 0

    def row():
        if open_:
            raise ValueError("an example lacks rows")
        n, turns, chars, loss, formatted = state
        return now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

    for conv, number, piece, text, size, n_turns, known, begin, end in rows:
        if state is None or conv != now:
            if state:
                yield row()
            now, state, whole, example = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], hashlib.sha256(), None
        if number != example:
            at, part, open_, example, seen, whole = 0, 0, True, number, whole, hashlib.sha256()
        if piece != part:
            raise ValueError("rows of an example are missing or out of order")
        if n_turns:
            s = str(text, "utf-8")
            cut = max(0, known - at)
            if open_:
                whole.update(s[:cut].encode())
                if at + cut != known or whole.digest() != seen.digest():
                    raise ValueError("an example's context is not the conversation before it")
                open_ = False
            s = s[cut:]
            whole.update(s.encode())
            parsed = parse_turns(s)
            state[0] += len(parsed)
            state[1].update("".join(f"{r}\n{t}\n" for r, t in parsed).encode())
            if begin is not None and begin < at + size:
                target = unescape(s[begin - at - cut : end - at - cut])
                state[2] += len(target)
                state[3].update(target.encode())
        else:
            whole.update(text)
        at, part = at + size, part + 1
        state[4] += size if begin is not None else max(0, min(size, at - known))
    if state:
        yield row()


def digests(examples: DataFrame) -> DataFrame:
    """One row a conversation, read back from whole examples whose rows lie in order, as prefix_targets() leaves them.

    formatted_chars counts the characters of all examples, each with its whole context, and of turns after the last reply."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        def rows():
            for b in batches:
                conv, example, part, text, n_turns, known, begin, end = b.columns
                yield from zip(*(c.to_pylist() for c in (conv, example, part)), (t.as_buffer() for t in text), *(c.to_pylist() for c in (pc.utf8_length(text), n_turns, known, begin, end)), strict=True)

        yield from _batches(_digests(rows()), _DIGEST, schema)

    return examples.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ADDED = "</s>[INST] ok [/INST]"


def query(spark, sf_dir: str) -> DataFrame:
    from veilspark.llm.shared import table

    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", ADDED), (-1, 1, "assistant", ADDED)], "conv_id long, turn long, role string, text string")
    return digests(prefix_targets(turns.unionByName(added)))


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
            + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')) + 22 AS chars FROM t
), p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
         max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM f
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) + coalesce(sum(chars) FILTER (last IS NULL OR turn > last), 0) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
