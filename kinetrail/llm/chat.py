r"""Chat formatting: schema fingerprints choose how a record's layout becomes canonical turns.

A record (a VARIANT) is described by its nested field paths, ``[]`` standing for any array
element; the hash of the sorted distinct paths is its fingerprint. Each known layout declares
where its turns are; the fingerprint selects the declaration. Fields that a layout declares as
optional (ids, names, origins) may be there or not and say nothing. Records of unknown fingerprints
keep ``layout`` null and have no turns. Everything is DataFrame expressions.

The template writes a turn as ``<turn>role\ntext</turn>\n``. Inside texts and roles ``\``
becomes ``\\`` and ``<`` becomes ``\l`` (in roles also a line feed ``\n``), so that no marker
can come from a text, and reading undoes it exactly. The loss mask lists the spans, in code
points of the formatted text, of assistant texts.

Nulls: a null text or role is empty; a null conversation id is a conversation of its own. Rows
that repeat are turns of their own; equal turn numbers go by role, then text; a null turn
number goes first. Empty tables give no conversations. Other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    ``many``: path of an array of messages with ``role`` and ``text`` fields and names of roles
    to rename; or ``fixed``: pairs of (role, path of its text) in order, absent ones left out.
    ``paths`` are all field paths of its records; one layout may list several variants. Paths
    in ``optional`` are left out of its records' fingerprints.
    """

    name: str
    paths: tuple[tuple[str, ...], ...]
    many: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, str], ...] = ()
    rename: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()


#: The field names of common public chat layouts.
ABOUT = ("id", "source", "model", "category", "timestamp")
LAYOUTS = (
    Layout(
        "messages",
        (("messages", "messages[].content", "messages[].role"),),
        many=("messages", "role", "content"),
        optional=(*ABOUT, "messages[].id", "messages[].name", "messages[].timestamp"),
    ),
    Layout(
        "sharegpt",
        (("conversations", "conversations[].from", "conversations[].value"),),
        many=("conversations", "from", "value"),
        rename=(("human", "user"), ("gpt", "assistant")),
        optional=(*ABOUT, "conversations[].weight"),
    ),
    Layout("instruction", (("instruction", "output"),), fixed=(("user", "instruction"), ("assistant", "output")), optional=ABOUT),
    Layout(
        "instruction with input",
        (("input", "instruction", "output"),),
        fixed=(("system", "instruction"), ("user", "input"), ("assistant", "output")),
        optional=ABOUT,
    ),
    Layout("prompt", (("completion", "prompt"), ("prompt", "response")), fixed=(("user", "prompt"), ("assistant", "completion"), ("assistant", "response")), optional=ABOUT),
)


def field_paths(record: Column) -> Column:
    """Sorted distinct field paths of a VARIANT, read off its schema string."""
    schema = F.schema_of_variant(record)
    # "OBJECT<a: ARRAY<OBJECT<b: STRING>>, c: STRING>": opening brackets push a name, closing ones pop it.
    tokens = F.regexp_extract_all(schema, F.lit(r"(`(?:[^`]|``)*`|[A-Za-z_0-9]+): |(ARRAY<)|(OBJECT<)|(>)"), F.lit(0))
    start = F.struct(F.lit("").alias("at"), F.array().cast("array<string>").alias("up"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, token: Column) -> Column:
        name = F.regexp_replace(token, "^`|`?: $", "")
        top = F.coalesce(F.get(acc["up"], F.lit(0)), F.lit(""))
        named = F.concat(top, F.when(top == "", "").otherwise("."), name)
        return (
            F.when(token.endswith(": "), F.struct(named.alias("at"), acc["up"].alias("up"), F.array_append(acc["out"], named).alias("out")))
            .when(token == "ARRAY<", F.struct(F.concat(acc["at"], F.lit("[]")).alias("at"), F.concat(F.array(acc["at"]), acc["up"]).alias("up"), acc["out"].alias("out")))
            .when(token == "OBJECT<", F.struct(acc["at"].alias("at"), F.concat(F.array(acc["at"]), acc["up"]).alias("up"), acc["out"].alias("out")))
            .otherwise(F.struct(F.coalesce(F.get(acc["up"], F.lit(0)), F.lit("")).alias("at"), F.slice(acc["up"], 2, 1 << 20).alias("up"), acc["out"].alias("out")))
        )

    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda acc: acc["out"])))


def fingerprint(paths: Column, optional: tuple[str, ...] = ()) -> Column:
    """Hash of sorted field paths, those in ``optional`` left out."""
    told = F.array_except(paths, F.array(*map(F.lit, optional))) if optional else paths
    return F.xxhash64(F.array_join(told, "\n"))


def _print_of(paths: tuple[str, ...]) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def canonical(record: Column, paths: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[Column, Column]:
    """(layout name, array of turns) of a VARIANT with the field paths ``paths``."""
    name, turns = F.lit(None).cast("string"), F.array().cast(TURN)
    for layout in reversed(layouts):
        is_it = fingerprint(paths, layout.optional).isin(*map(_print_of, layout.paths))
        if layout.many:
            made = _messages(record, layout)
        else:
            parts = [F.struct(F.lit(role).alias("role"), F.try_variant_get(record, f"$.{path}", "string").alias("text")) for role, path in layout.fixed]
            made = F.filter(F.array(*parts), lambda m: m["text"].isNotNull())
        name = F.when(is_it, F.lit(layout.name)).otherwise(name)
        turns = F.when(is_it, F.coalesce(made, F.array().cast(TURN))).otherwise(turns)
    return name, turns


def _messages(record: Column, layout: Layout) -> Column:
    path, role, text = layout.many
    items = F.try_variant_get(record, f"$.{path}", f"array<struct<`{role}`:string,`{text}`:string>>")
    return F.transform(items, lambda m: F.struct(_renamed(m[role], layout.rename).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))


def _renamed(role: Column, names: tuple[tuple[str, str], ...]) -> Column:
    out = F.coalesce(role, F.lit(""))
    for old, new in names:
        out = F.when(role == old, F.lit(new)).otherwise(out)
    return out


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    parts = F.split(text, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))), "\\")


def records(turns: DataFrame) -> DataFrame:
    """(conv_id, record): rows by turn gathered into VARIANTs of the messages layout.

    A conversation is one record, so its turns meet in one task whatever their number.
    """
    return gathered(turns).select("conv_id", as_messages(F.col("turns")).alias("record"))


def gathered(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, nulls empty."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return listed.select("conv_id", F.transform("rows", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("turns"))


def as_messages(turns: Column, **about: Column) -> Column:
    messages = F.transform(turns, lambda m: F.struct(m["text"].alias("content"), m["role"].alias("role")))
    return F.to_variant_object(F.struct(messages.alias("messages"), *[c.alias(name) for name, c in about.items()]))


def as_sharegpt(turns: Column) -> Column:
    """Null where a role already has one of the names that the layout writes for others."""
    layout = next(x for x in LAYOUTS if x.name == "sharegpt")
    taken = F.exists(turns, lambda m: m["role"].isin(*[old for old, _ in layout.rename]))
    back = tuple((new, old) for old, new in layout.rename)
    said = F.transform(turns, lambda m: F.struct(_renamed(m["role"], back).alias("from"), m["text"].alias("value")))
    return F.when(~taken, F.to_variant_object(F.struct(said.alias("conversations"))))


def as_instruction(turns: Column) -> Column:
    """Null unless a user's turn and an assistant's are all there is."""
    roles = F.transform(turns, lambda m: m["role"])
    fits = roles == F.array(F.lit("user"), F.lit("assistant"))
    text = lambda k: F.get(turns, F.lit(k))["text"]
    return F.when(fits, F.to_variant_object(F.struct(text(0).alias("instruction"), text(1).alias("output"))))


def mixed_records(turns: DataFrame) -> DataFrame:
    """(conv_id, record): conversations in the layouts that corpora mix, by conv_id modulo 4.

    0, and where nothing else fits: messages; 1: sharegpt; 2: instruction; 3: messages with an id.
    """
    kind, listed = F.pmod("conv_id", F.lit(4)), F.col("turns")
    plain = as_messages(listed)
    record = F.when(kind == 1, F.coalesce(as_sharegpt(listed), plain)).when(kind == 2, F.coalesce(as_instruction(listed), plain))
    return gathered(turns).select("conv_id", record.when(kind == 3, as_messages(listed, id=F.col("conv_id"))).otherwise(plain).alias("record"))


def formatted(records: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, layout, formatted, loss): the written text and the loss spans of each record."""
    marked = records.select(F.col(key).alias("_key"), F.col("record").alias("_record"), field_paths(F.col("record")).alias("_paths"))
    name, turns = canonical(F.col("_record"), F.col("_paths"))

    def written(t: Column) -> Column:
        role = F.replace(escaped(t["role"]), F.lit("\n"), F.lit("\\n"))
        return F.struct(F.concat(F.lit("<turn>"), role, F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss"))

    parts = marked.select("_key", name.alias("layout"), F.transform(turns, written).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("</turn>\n"))), "")
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def span(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len("</turn>\n")).alias("at"), F.when(p["loss"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    loss = F.aggregate("parts", first, span, lambda acc: acc["spans"])
    return parts.select(F.col("_key").alias(key), "layout", text.alias("formatted"), loss.alias("loss"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(text, "</turn>\n"), lambda p: p.startswith("<turn>"))

    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        return F.struct(
            unescaped(F.substring(p, F.lit(len("<turn>") + 1), cut - 1 - len("<turn>"))).alias("role"),
            unescaped(F.substring(p, cut + 1, F.length(p))).alias("text"),
        )

    return F.transform(pieces, turn)


def read_loss(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, without anything between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(done: DataFrame, key: str = "conv_id") -> DataFrame:
    """What a reader gets back from formatted records: counts, and digests of turns and of the loss text."""
    read = done.select(key, "layout", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("loss_text"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )
