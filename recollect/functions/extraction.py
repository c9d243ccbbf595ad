"""What language models answer, read leniently: entities, triples, memories and labels from output that may be fenced,
chatty or cut off, and triples grounded in the text that they were drawn from. What is read from one output in several
ways is looked for once by ``text.lenient_objects`` and passed on as ``found``. Models themselves are a slot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions import temporal as D
from recollect.functions import text as X


def _objects(output: Column, found: bool, needed: list[str], optional: dict[str, str | None]) -> Column:
    """The objects that have all needed fields, as structs of text; optional ones take a default."""
    objects = output if found else X.lenient_objects(output)
    schema = ", ".join(f"`{n}` string" for n in (*needed, *optional))
    read = lambda o: F.from_json(o, schema, {"allowNonNumericNumbers": "false"})
    filled = lambda s: F.struct(*(s[n].alias(n) for n in needed), *(F.coalesce(s[n], F.lit(d).cast("string")).alias(n) for n, d in optional.items()))

    def whole(s: Column) -> Column:
        ok = s[needed[0]].isNotNull()
        for n in needed[1:]:
            ok = ok & s[n].isNotNull()
        return ok

    return F.transform(F.filter(F.transform(objects, read), whole), filled)


def entities(output: Column, found: bool = False) -> Column:
    """(name, type); a type that isn't given is unknown."""
    return _objects(output, found, ["name"], {"type": "unknown"})


def triples(output: Column, found: bool = False) -> Column:
    """(subject, predicate, object, when, quote)."""
    return _objects(output, found, ["subject", "predicate", "object"], {"when": None, "quote": None})


def memories(output: Column, found: bool = False) -> Column:
    """(content, type)."""
    return _objects(output, found, ["content"], {"type": "unknown"})


def label(output: Column, labels: list[str]) -> Column:
    """The label that stands first in the answer, the longer where two begin alike; null where none does."""
    low = F.lower(output)
    ranked = [F.struct(F.nullif(F.instr(low, F.lit(x.lower())), F.lit(0)).alias("at"), F.lit(-len(x)).alias("size"), F.lit(x).alias("x")) for x in labels]
    found = F.filter(F.array(*ranked), lambda s: s["at"].isNotNull())
    return F.try_element_at(F.array_sort(found), F.lit(1))["x"]


def grounded(triple: Column, text: Column, day: Column, locale: D.Locale = D.Locale()) -> Column:
    """A triple with what the text bears out: valid_from, where its ``when`` stands there and names a date, and support,
    the bytes (offset, len) of its quote."""
    when = D.claimed_span(triple["when"], text, day, locale)["resolved"]
    return F.struct(triple["subject"].alias("subject"), triple["predicate"].alias("predicate"), triple["object"].alias("object"), when.alias("valid_from"), X.locate(triple["quote"], text).alias("support"))
