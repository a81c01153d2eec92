"""Preference formatting: shared prompts and masked completions of conversations.

The longest common turn prefix of a chosen and a rejected conversation is
rendered once, as their prompt; what follows in each conversation is its
completion, of which only assistant turns bear loss.  Pairs are given, or found
in two ways.

* *opening*: conversations that agree up to their first user turn.  Of each
  group the one with the most assistant text is chosen, ties going to the
  smallest id, and every other one is rejected against it, so that pairs grow
  with the conversations, not with the square of a group.
* *reply*: a conversation up to its last assistant turn, against itself with
  another conversation's last reply in that place.  The other one is the next
  different reply, by hash, in a bucket of conversations dealt by hash.

Turns without a conversation's id belong to none and give no row.  A
conversation is one row and its rendered text one value, of 2 GB at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import join_one, pick, small_batches, written

Turn = tuple[str, str]  # role, text


def render(turn: Turn) -> str:
    """A turn between markers; the start of a marker within a text is set apart."""
    role, text = turn
    return f"<|{role}|>\n{text.replace('<|', '< |')}<|end|>\n"


def common_prefix(a: list[Turn], b: list[Turn]) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def completion(turns: list[Turn]) -> tuple[str, list[dict[str, int]]]:
    """Rendered turns, and the spans of characters that bear loss: assistants' texts with their end markers."""
    parts, spans, at = [], [], 0
    for turn in turns:
        text = render(turn)
        if turn[0] == "assistant":
            spans.append({"start": at + len(f"<|{turn[0]}|>\n"), "end": at + len(text)})
        parts.append(text)
        at += len(text)
    return "".join(parts), spans


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_OUT = (
    "kind string, chosen_id long, rejected_id long, status string, prompt_turns long, prompt string, chosen string, rejected string, "
    "chosen_loss array<struct<start:long,end:long>>, rejected_loss array<struct<start:long,end:long>>"
)
#: Conversations of a bucket in which replies are exchanged, and pairs that read one conversation in one task.
BUCKET, SHARE = 4096, 1024


def _conversations(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    plain = pick(turns, conv_col, turn_col, role_col, text_col).toDF("conv_id", "turn", "role", "text")
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = plain.where("conv_id is not null").groupBy(F.col("conv_id").cast("long")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    user = F.array_position(F.transform("turns", lambda t: t.role), "user")
    opening = F.when(user > 0, F.slice("turns", F.lit(1), user.cast("int"))).otherwise(F.slice("turns", 1, 1))
    return gathered.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"),
        F.sha2(F.to_json(F.transform(opening, lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))), 256).alias("opening"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + F.when(t.role == "assistant", F.length(t.text)).otherwise(0)).alias("weight"),
        F.md5(F.try_element_at(F.filter("turns", lambda t: t.role == "assistant"), F.lit(-1)).text).alias("reply"),
    )


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A written row for each conversation: conv_id, turns in order, hashes of its opening and last reply, and its assistants' characters.

    Null roles and texts are empty.  Turns are ordered by number, then role and
    text, so repeated turns follow each other.  The opening ends with the first
    user turn; without one it is the first turn.
    """
    return written(_conversations(turns, conv_col, turn_col, role_col, text_col), "conversations")


def pairs_by_opening(whole: DataFrame) -> DataFrame:
    """(kind, chosen_id, rejected_id): in each group of one opening, its best conversation against every other."""
    best = F.max_by("conv_id", F.struct("weight", (-F.col("conv_id")).alias("least")))
    groups = written(whole.groupBy("opening").agg(best.alias("chosen_id"), F.count("*").alias("n")).where("n > 1"), "openings")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    matched = join_one(whole.select("conv_id", "opening"), groups, "opening", "n", total).where("conv_id <> chosen_id")
    return matched.select(F.lit("opening").alias("kind"), "chosen_id", F.col("conv_id").alias("rejected_id"))


def pairs_by_reply(whole: DataFrame) -> DataFrame:
    """(kind, chosen_id, rejected_id): each conversation with an assistant's turn, and the one whose last reply stands against its own.

    Conversations are dealt into buckets of about BUCKET by the hash of their id;
    in each, distinct replies stand in a circle by hash, and the smallest id that
    has the next one gives it.  Where a bucket has one reply only, there is none.
    """
    own = whole.where("reply is not null").select("conv_id", "reply")
    count, digits = own.count(), 0
    while count > BUCKET * 16**digits:
        digits += 1
    dealt = own.withColumn("bucket", F.substring(F.md5(F.col("conv_id").cast("string")), 1, digits))
    circle = dealt.groupBy("bucket", "reply").agg(F.min("conv_id").alias("giver"))
    place = Window.partitionBy("bucket").orderBy("reply")
    first = F.first("giver").over(place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = circle.withColumn("rejected_id", F.coalesce(F.lead("giver").over(place), first)).withColumn("n", F.count("*").over(Window.partitionBy("bucket")))
    following = following.where("n > 1").drop("giver", "n")
    found = dealt.join(following, ["bucket", "reply"])
    return found.select(F.lit("reply").alias("kind"), F.col("conv_id").alias("chosen_id"), "rejected_id")


def _with_turns(pairs: DataFrame, whole: DataFrame, id_col: str, into: str) -> DataFrame:
    """Pairs with the turns of one side: a conversation in very many pairs is copied, so that no task gets all of them."""
    often = pairs.groupBy(id_col).agg(F.ceil(F.count("*") / SHARE).alias("copies"))
    turns = whole.select(F.col("conv_id").alias(id_col), F.col("turns").alias(into))
    copies = turns.join(often, id_col).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    one = written(often.where("copies > 1"), "common-conversations")  # at most one for SHARE pairs
    salted = pairs.join(F.broadcast(one), id_col, "left")
    salted = salted.withColumn("copy", F.pmod(F.xxhash64("kind", "chosen_id", "rejected_id"), F.coalesce("copies", F.lit(1).cast("long")))).drop("copies")
    return salted.join(copies, [id_col, "copy"]).drop("copy")


def format_pairs(whole: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for each of ``pairs`` (kind, chosen_id, rejected_id): the prompt, both completions and their loss spans.

    ``whole`` is what :func:`conversations` returns.  Of kind ``reply`` the
    chosen conversation ends with its last assistant turn, and the rejected one
    is the same with the other's last reply there; of any other kind both are
    whole.  ``status`` is ok, no_prompt where the two share no turn, or no_loss
    where a completion has nothing to learn.  Repeated pairs count once; a pair
    that names a missing conversation has no row; equal conversations have empty
    completions.  An empty table gives none.
    """
    small_batches(whole.sparkSession)
    pairs = written(pick(pairs, "kind", "chosen_id", "rejected_id").distinct(), "pairs")
    both = _with_turns(written(_with_turns(pairs, whole, "rejected_id", "rejected"), "half-pairs"), whole, "chosen_id", "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, chosen_id, rejected_id, c, r in zip(*(x.to_pylist() for x in batch.columns)):
                c, r = ([(t["role"], t["text"]) for t in x] for x in (c, r))
                if kind == "reply":
                    at, given = (max((i for i, t in enumerate(x) if t[0] == "assistant"), default=-1) for x in (c, r))
                    c, r = c[: at + 1], c[:at] + r[given : given + 1]
                n = common_prefix(c, r)
                (chosen_text, chosen_loss), (rejected_text, rejected_loss) = completion(c[n:]), completion(r[n:])
                status = "no_prompt" if not n else "ok" if chosen_loss and rejected_loss else "no_loss"
                rows.append((kind, chosen_id, rejected_id, status, n, "".join(map(render, c[:n])), chosen_text, rejected_text, chosen_loss, rejected_loss))
            kinds = [pa.string()] + [pa.int64()] * 2 + [pa.string(), pa.int64()] + [pa.string()] * 3 + [_SPANS] * 2
            names = [x.split()[0] for x in _OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return both.select("kind", "chosen_id", "rejected_id", "chosen", "rejected").mapInArrow(run, _OUT)


def with_bounds(pairs: DataFrame) -> DataFrame:
    """Pairs with spans as text, ``start-end`` and commas between, so that they compare as values."""

    def shown(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws("-", s.start, s.end)), ",").alias(column)

    return pairs.select(*[shown(c) if c.endswith("_loss") else F.col(c) for c in pairs.columns])
