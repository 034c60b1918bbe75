"""Chat formatting by quotation linking: who answers whom is read from what is quoted."""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import cut, send_by_value

send_by_value(__name__)

QUOTE = re.compile(r"(?:[ \t]{0,3}>)+ ?")
#: A line that introduces a quote: it ends in a colon, and has a date, a time, an address or a verb of telling.
INTRO = re.compile(r"^(?=.{1,300}:\s*$)(?:.*[\d@<].*|.*\b(?:wrote|writes|said|says|schrieb|schreibt|sagte|écrit|dit|escribió|dijo|scrisse|ha scritto|escreveu)\b.*)$", re.I)
NOT_WORD = re.compile(r"[\W_]+")
#: Normalised passages shorter than this are common: their original is the latest message before, and longer ones count first.
LEAST_CHARS = 12

PARSED = StructType(
    [
        StructField("body", StringType()),
        StructField("quotes", ArrayType(StructType([StructField("level", IntegerType()), StructField("hash", LongType()), StructField("rank", IntegerType())]))),
        StructField("own", ArrayType(LongType())),
    ]
)


def normalise(passage: str) -> str:
    """Lower-cased words of a passage, so that line breaks, blanks and punctuation don't matter."""
    return NOT_WORD.sub(" ", passage.lower()).strip()


def passage_hash(passage: str) -> int | None:
    plain = normalise(passage)
    return xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) - (1 << 63) if plain else None


def _quote_level(line: str) -> tuple[int, str]:
    m = QUOTE.match(line)
    return (m[0].count(">"), line[m.end() :]) if m else (0, line)


def parse_quotes(text: str | None) -> tuple[str, list[tuple[int, int, int]], list[int]]:
    """The body without quotes, ``(level, hash, rank)`` of quoted passages, and hashes of the body's own passages.

    A passage is a run of lines of one quote level; it is hashed whole and line
    by line, as a reply may quote a part; rank 0 is a long passage, 1 a short
    run, 2 a short line of a run.  A body is hashed whole, by paragraph
    and by line.  An introduction ("On ... wrote:") right before a quote goes with it.
    """
    kept: list[str] = []
    quotes: dict[tuple[int, int], int] = {}
    run: list[str] = []
    level = 0

    def end_run() -> None:
        for i, passage in enumerate((" ".join(run), *run)):
            if (h := passage_hash(passage)) is not None:
                rank = 0 if len(normalise(passage)) >= LEAST_CHARS else 1 if i == 0 else 2
                quotes[level, h] = min(rank, quotes.get((level, h), rank))

    for line in (text or "").split("\n"):
        at, rest = _quote_level(line)
        if at != level:
            if level:
                end_run()
            run, level = [], at
        if at:
            if kept and len(run) == 0 and INTRO.match(kept[-1].strip()):
                kept.pop()
            run.append(rest)
        else:
            kept.append(line)
    if level:
        end_run()
    body = "\n".join(kept).strip("\n")
    own = {h: None for passage in (body, *re.split(r"\n\s*\n", body), *body.split("\n")) if (h := passage_hash(passage)) is not None}
    return body, [(*q, rank) for q, rank in quotes.items()], list(own)


@F.pandas_udf(PARSED)
def parse_udf(texts: pd.Series) -> pd.DataFrame:
    rows = [parse_quotes(x) for x in texts]
    return pd.DataFrame({"body": [b for b, _, _ in rows], "quotes": [[{"level": lv, "hash": h, "rank": k} for lv, h, k in q] for _, q, _ in rows], "own": [o for _, _, o in rows]})


#: Turns in one range; ranges are put in order by themselves, so a long conversation is dealt over tasks.
RANGE = 1024


def latest_before(rows: DataFrame, *keys: str) -> DataFrame:
    """``(keys, turn, latest)``: of ``rows`` of keys, turn and ``own`` (the turn or null), the greatest ``own`` below each turn."""
    ranged = rows.filter(F.col("turn").isNotNull()).groupBy(*keys, "turn").agg(F.max("own").alias("own")).withColumn("range", F.floor(F.col("turn") / RANGE))
    earlier = (Window.unboundedPreceding, -1)
    ends = ranged.groupBy(*keys, "range").agg(F.max("own").alias("end"))
    ends = ends.select(*keys, "range", F.max("end").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(*earlier)).alias("end"))
    within = F.max("own").over(Window.partitionBy(*keys, "range").orderBy("turn").rowsBetween(*earlier))
    return ranged.select(*keys, "range", "turn", within.alias("within")).join(ends, [*keys, "range"]).select(*keys, "turn", F.coalesce("within", "end").alias("latest"))


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> tuple[DataFrame, DataFrame]:
    """The parsed messages, each once, and ``(conv, turn, parent)`` for those that quote an earlier message.

    The original of a passage is the first message of the conversation that
    has it in its own words, of a short one the latest before the quote.  Of
    several originals the outermost quote's holds, of those at one level a
    long passage's, of these the latest.
    """
    parsed = cut(messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), parse_udf(F.col(text_col)).alias("p")).select("conv", "turn", "role", "p.*"))
    quoted = parsed.select("conv", "turn", F.explode("quotes").alias("q")).select("conv", "turn", "q.level", "q.hash", "q.rank").distinct()
    asked = quoted.select("conv", "hash").distinct()
    own = parsed.select("conv", "turn", F.explode("own").alias("hash")).join(asked, ["conv", "hash"], "left_semi")
    first = own.groupBy("conv", "hash").agg(F.min("turn").alias("original"))
    long = quoted.filter("rank = 0").join(first, ["conv", "hash"]).filter(F.col("original") < F.col("turn"))
    short = quoted.filter("rank > 0")
    places = own.select("conv", "hash", "turn", F.col("turn").alias("own")).unionByName(short.select("conv", "hash", "turn", F.lit(None).cast(own.schema["turn"].dataType).alias("own")))
    latest = latest_before(places, "conv", "hash").filter("latest is not null").withColumnRenamed("latest", "original")
    hits = long.unionByName(short.join(latest, ["conv", "hash", "turn"]), allowMissingColumns=True)
    parents = hits.groupBy("conv", "turn").agg(F.min(F.struct("level", "rank", (-F.col("original")).alias("late"))).alias("best"))
    return parsed, parents.select("conv", "turn", (-F.col("best.late")).alias("parent"))


def reply_order(parents: DataFrame) -> DataFrame:
    """``(conv, turn, parent, root, depth)`` by pointer doubling: as many rounds as the logarithm of the longest chain."""
    state = cut(parents.select("conv", "turn", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth")))
    while True:
        above = state.select("conv", F.col("turn").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        state = cut(state.join(above, ["conv", "root"], "left").select("conv", "turn", "parent", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up").isNotNull().alias("moved")))
        if state.filter("moved").isEmpty():
            return state.drop("moved")
        state = state.drop("moved")


def _in_order(number: Column) -> Column:
    """A long as text that sorts as the number does."""
    return F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conversation, turn, role, ``text`` without quotes, and its place in reply order.

    ``quoted_turn`` is the message that it quotes, or null.  Threads are made
    of quotes: ``root_turn`` opens the thread, ``depth`` counts the quotes up to
    there, and ``reply_key`` sorts a conversation: threads by their root, in
    them by turn, so that an answer follows what it quotes.  ``parent_turn`` is the
    message that it most likely answers: the quoted one, else the one
    before in the conversation, else null; it makes no threads.  ``line`` is the turn
    in chat form; ``<|`` in a role or text becomes ``< |`` there, so that nobody can forge a turn.  Rows stay
    apart, so a conversation of any size is never gathered in one task.

    Null texts have an empty body and null roles become ``user``.  Rows
    with a null conversation or turn stay, unlinked (a null turn has a null ``reply_key``); repeated rows (one
    conversation and turn) all stay and share their links.  Other columns are
    ignored, whatever their names; no rows give no rows.
    """
    parsed, parents = link(messages, conv_col, turn_col, text_col, role_col)
    placed = cut(reply_order(parents))
    before = latest_before(parsed.filter("conv is not null").select("conv", "turn", F.col("turn").alias("own")), "conv").withColumnRenamed("latest", "previous")
    base = parsed.select("conv", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.col("body").alias("text"))
    joined = base.join(before, ["conv", "turn"], "left").join(placed, ["conv", "turn"], "left")
    root = F.coalesce("root", "turn")

    def plain(text: Column) -> Column:
        return F.replace(text, F.lit("<|"), F.lit("< |"))

    return joined.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        "text",
        F.col("parent").alias("quoted_turn"),
        F.coalesce("parent", "previous").alias("parent_turn"),
        root.alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.when(F.col("turn").isNotNull(), F.concat_ws("/", _in_order(root), _in_order(F.col("turn")))).alias("reply_key"),
        F.concat(F.lit("<|"), plain(F.col("role")), F.lit("|>\n"), plain(F.col("text"))).alias("line"),
    )
