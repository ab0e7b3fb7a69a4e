"""Column functions over steps: families, sequences, argument classes, canonical arguments, texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def family(tool: Column) -> Column:
    return F.when(tool.startswith("mcp"), F.lit("mcp")).otherwise(tool)


def succeeded(outcome: Column) -> Column:
    return F.coalesce(outcome == "stop", F.lit(False))


def labelled(verified: Column) -> Column:
    return F.coalesce(verified.isin("success", "failure"), F.lit(False))


def tool_sequence(steps: Column) -> Column:
    return F.transform(steps, lambda s: s["tool"])


def family_sequence(steps: Column) -> Column:
    return F.transform(steps, lambda s: family(s["tool"]))


def family_multiset(steps: Column) -> Column:
    """Sorted (family, count) pairs."""
    families = family_sequence(steps)
    return F.transform(F.array_sort(F.array_distinct(families)), lambda f: F.struct(f.alias("family"), F.size(F.filter(families, lambda x: x == f)).alias("count")))


def has_error(error: Column) -> Column:
    """An empty text is no error."""
    return F.coalesce(error, F.lit("")) != ""


def error_flags(steps: Column) -> Column:
    return F.transform(steps, lambda s: has_error(s["error"]))


def extension(path: Column) -> Column:
    """The last suffix of the file name with its dot; dots that begin the name begin no suffix."""
    name = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"^\.+", "")
    return F.regexp_extract(name, r"(\.[^.]*)$", 1)


def _field(args: Column, *names: str) -> Column:
    """The first of the named top-level fields that is there and not empty."""
    return F.coalesce(*(F.nullif(F.get_json_object(args, f"$.{n}"), F.lit("")) for n in names), F.lit(""))


# Names of a file operation's path, of the ranges and of the bodies that tell file operations apart.
PATHS = ("path", "file_path", "filePath")
RANGE_FIELDS = ("offset", "limit", "start", "end", "range", "line", "lines")
BODY_FIELDS = ("content", "new_string", "old_string", "new_str", "old_str", "newText", "oldText", "text")


def arg_class(tool: Column, args: Column) -> Column:
    """A coarse class of a step's arguments, as text.

    Shell: first word, whether it pipes, whether it redirects.  File tools: the extension.
    Wrapped tools: the inner tool, or else the tool.  Others: the tool.
    """
    command = _field(args, "command")
    first = F.coalesce(F.get(F.split(collapsed(command), " "), 0), F.lit(""))
    shell = F.concat_ws("|", F.lit("bash"), first, F.contains(command, F.lit("|")).cast("string"), F.contains(command, F.lit(">")).cast("string"))
    files = F.concat_ws("|", tool, extension(_field(args, *PATHS)))
    return F.when(tool == "bash", shell).when(tool.isin("read", "write", "edit"), files).when(tool.startswith("mcp"), F.concat_ws("|", F.lit("mcp"), inner_tool(tool, args))).otherwise(tool)


def inner_tool(tool: Column, args: Column) -> Column:
    """What a wrapped call is of: its tool, or name, or else the wrapper itself."""
    return F.coalesce(F.nullif(_field(args, "tool", "name"), F.lit("")), tool)


def ordered_json(text: Column) -> Column:
    """JSON with keys in order at every depth and equal decimals alike; text that is none, or that names a key twice, as it is.

    Numbers with an exponent are kept as doubles, so 1e2 and 100 are told apart.
    """
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def canonical_args(tool: Column, args: Column) -> Column:
    """A key that loses nothing of what a step does, as text.

    Shell: the command with white space collapsed.  File tools: the path, then ranges and
    bodies that are there, bodies with their length before them.  Wrapped tools: the inner
    tool and its arguments in order.  Others: all arguments in order.
    """
    value = lambda k: F.get_json_object(args, f"$.{k}")
    ranges = [F.concat(F.lit(f"{k}="), value(k)) for k in RANGE_FIELDS]
    bodies = [F.concat(F.lit(f"{k}#"), F.length(value(k)).cast("string"), F.lit(":"), value(k)) for k in BODY_FIELDS]
    files = F.concat_ws("\u001f", _field(args, *PATHS), *ranges, *bodies)
    wrapped = F.concat_ws("\u001f", inner_tool(tool, args), ordered_json(F.coalesce(value("args"), value("arguments"))))
    return F.when(tool == "bash", collapsed(_field(args, "command"))).when(tool.isin("read", "write", "edit"), files).when(tool.startswith("mcp"), wrapped).otherwise(ordered_json(args))


def collapsed(text: Column, cap: int | None = None) -> Column:
    """White space as single spaces, trimmed, cut to ``cap`` characters."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.left(out, F.lit(cap)) if cap else out


def shown_args(tool: Column, args: Column) -> Column:
    """Arguments for display only: commands and paths cut to 160 characters, wrapped ones to 80 after the inner tool, others in order."""
    value = lambda k: F.get_json_object(args, f"$.{k}")
    inner = F.concat(inner_tool(tool, args), F.lit(":"), F.left(F.coalesce(value("args"), value("arguments"), F.lit("")), F.lit(80)))
    return F.when(tool == "bash", collapsed(_field(args, "command"), 160)).when(tool.isin("read", "write", "edit"), F.left(_field(args, *PATHS), F.lit(160))).when(tool.startswith("mcp"), inner).otherwise(F.left(F.coalesce(ordered_json(args), F.lit("{}")), F.lit(160)))


def seeded_index(key: Column, n: Column) -> Column:
    """A place among ``n`` drawn by a text's SHA-256, read as one number; 0 if there are none.

    The remainder is taken digit by digit, so no number outgrows 64 bits while n is under 2^59.
    """
    digits = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.substring(F.sha2(key, 256), i, F.lit(1)), 16, 10).cast("long"))
    return F.when(n > 0, F.aggregate(digits, F.lit(0).cast("long"), lambda t, d: (t * 16 + d) % n.cast("long"))).otherwise(F.lit(0).cast("long"))


def task_of(prompt: Column) -> Column:
    return F.coalesce(prompt, F.lit(""))
