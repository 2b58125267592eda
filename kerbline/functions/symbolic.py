"""Four-stage reasoning documents: parsing, printing, validation and grounding as column expressions.

A document has the sections PERCEPTION, OPERATIONS, FACTS, RULES and ACTION.  Everything below works on one
text column; nothing is exploded, so a document stays one row in one stage.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The section headers and the operation names of the document format.
SECTIONS = ("PERCEPTION", "OPERATIONS", "FACTS", "RULES", "ACTION")
OPERATIONS = ("Query", "Filter", "Count", "Exists", "Nearest", "EgoQuery")


@dataclass(frozen=True)
class Condition:
    """One way to ground a fact.  kind: entity, no_entity, ego (what EgoQuery operations say, attribute by attribute) or judgment."""

    kind: str
    base_type: str | None = None
    subtype: str | None = None
    equals: dict[str, str] = field(default_factory=dict)
    among: dict[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class Vocabulary:
    """types: type or subtype -> base type; attributes: base type -> attribute -> values; facts -> conditions, any of which grounds it."""

    types: dict[str, str]
    attributes: dict[str, dict[str, tuple[str, ...]]]
    facts: dict[str, tuple[Condition, ...]]
    lateral: tuple[str, ...]
    longitudinal: tuple[str, ...]
    same: tuple[tuple[str, ...], ...] = ()


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _lines(body: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(body, F.lit("")), "[\t\r]", " "), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _bodies(text: Column) -> Column:
    """array of the bodies of SECTIONS; text is named often, so it is a column or bound by let."""
    found = []
    for s in SECTIONS:
        pattern = rf"(?i)\b{s}\s*:"
        found.append(F.struct(F.regexp_instr(text, F.lit(pattern)).alias("at"), F.char_length(F.regexp_extract(text, pattern, 0)).alias("size")))

    def bodies(heads: Column) -> Column:
        def body(h: Column) -> Column:
            later = F.array_min(F.filter(F.transform(heads, lambda o: o["at"]), lambda at: at > h["at"]))
            start = h["at"] + h["size"]
            return F.when(h["at"] > 0, F.trim(F.substring(text, start, F.coalesce(later, F.char_length(text) + 1) - start)))

        return F.transform(heads, body)

    return let(F.array(*found), bodies)


def _named(every: Column) -> dict[str, Column]:
    return {s: F.get(every, F.lit(k)) for k, s in enumerate(SECTIONS)}


def sections(text: Column) -> dict[str, Column]:
    """Body of each section (null if the header is missing): from its first header to the next header that was found."""
    return _named(let(text, _bodies))


_ENTITY = r"^(\w+)\s*=\s*(\w+)\s*\{([^}]*)\}"


def entities(body: Column, vocab: Vocabulary) -> Column:
    """array of (id, entity_type, base_type, attributes, error)."""
    types = F.create_map(*[F.lit(x) for kv in sorted(vocab.types.items()) for x in kv])

    def one(line: Column) -> Column:
        parts = F.filter(F.transform(F.split(F.regexp_extract(line, _ENTITY, 3), ","), lambda x: F.trim(x)), lambda p: p != "")
        pairs = F.transform(parts, lambda p: let(F.split(p, ":", 2), lambda kv: F.struct(F.trim(kv[0]).alias("key"), F.trim(F.get(kv, F.lit(1))).alias("value"))))
        return let(F.struct(F.regexp_extract(line, _ENTITY, 1).alias("id"), F.regexp_extract(line, _ENTITY, 2).alias("kind"), F.regexp_like(line, F.lit(_ENTITY)).alias("ok"), pairs.alias("pairs")), lambda r: made(line, r))

    def made(line: Column, r: Column) -> Column:
        base = F.try_element_at(types, r.kind)
        good = F.filter(r.pairs, lambda p: p.value.isNotNull())
        last = F.filter(r.pairs, lambda p, i: p.value.isNotNull() & ~F.exists(F.slice(r.pairs, i + 2, F.size(r.pairs)), lambda o: (o.key == p.key) & o.value.isNotNull()))
        error = (
            F.when(~r.ok, F.concat(F.lit("bad entity line: "), line))
            .when(base.isNull(), F.concat(F.lit("unknown entity type: "), r.kind))
            .when(F.size(good) < F.size(r.pairs), F.concat(F.lit("bad attribute: "), line))
        )
        return F.struct(r.id.alias("id"), r.kind.alias("entity_type"), base.alias("base_type"), F.map_from_entries(last).alias("attributes"), error.alias("error"))

    return F.transform(_lines(body), one)


def operations(body: Column) -> Column:
    """array of (op_type, expression, result, error): a line splits at its first equals sign."""
    pattern = r"^(.+?)\s*=\s*(.+)$"

    def one(line: Column) -> Column:
        expression = F.regexp_extract(line, pattern, 1)
        op = F.trim(F.split(expression, r"\(", 2)[0])
        error = F.when(~F.regexp_like(line, F.lit(pattern)), F.concat(F.lit("bad operation line: "), line)).when(~op.isin(*OPERATIONS), F.concat(F.lit("unknown operation: "), op))
        return F.struct(op.alias("op_type"), expression.alias("expression"), F.regexp_extract(line, pattern, 2).alias("result"), error.alias("error"))

    return F.transform(_lines(body), one)


def facts(body: Column) -> Column:
    """array of (name, value, error)."""
    pattern = r"^(\w+)\s*=\s*(True|False)$"

    def one(line: Column) -> Column:
        ok = F.regexp_like(line, F.lit(pattern))
        return F.struct(
            F.regexp_extract(line, pattern, 1).alias("name"), F.when(ok, F.regexp_extract(line, pattern, 2) == "True").alias("value"), F.when(~ok, F.concat(F.lit("bad fact line: "), line)).alias("error")
        )

    return F.transform(_lines(body), one)


def rules(body: Column) -> Column:
    """array of (conditions, lateral, longitudinal, error)."""

    def one(line: Column) -> Column:
        halves = F.split(F.regexp_replace(line, "→", "->"), "->", 2)
        names = F.transform(F.split(F.trim(halves[0]), r"\s+AND\s+"), lambda x: F.trim(x))
        conditions = F.transform(names, lambda n: F.struct(F.trim(F.regexp_replace(n, r"^NOT\s+", "")).alias("name"), (~F.regexp_like(n, F.lit(r"^NOT\s"))).alias("expected")))
        actions = F.transform(F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ","), lambda x: F.trim(x))
        error = F.when(F.size(halves) < 2, F.concat(F.lit("rule without arrow: "), line)).when(F.size(actions) != 2, F.concat(F.lit("rule needs two actions: "), line))
        return F.struct(conditions.alias("conditions"), F.get(actions, F.lit(0)).alias("lateral"), F.get(actions, F.lit(1)).alias("longitudinal"), error.alias("error"))

    return F.transform(_lines(body), one)


def action(body: Column) -> Column:
    """(lateral, longitudinal, error) from the first line."""
    parts = F.transform(F.split(F.coalesce(F.get(_lines(body), F.lit(0)), F.lit("")), ","), lambda x: F.trim(x))
    ok = F.size(parts) == 2
    return F.struct(F.when(ok, parts[0]).alias("lateral"), F.when(ok, F.get(parts, F.lit(1))).alias("longitudinal"), F.when(~ok, F.lit("bad action")).alias("error"))


def parse(text: Column, vocab: Vocabulary) -> Column:
    """The whole document as a struct; `errors` is empty if it parsed."""
    return let(let(text, _bodies), lambda every: _parsed(_named(every), vocab))


def _parsed(body: dict[str, Column], vocab: Vocabulary) -> Column:
    parts = {
        "entities": entities(body["PERCEPTION"], vocab),
        "operations": operations(body["OPERATIONS"]),
        "facts": facts(body["FACTS"]),
        "rules": rules(body["RULES"]),
    }
    none = F.coalesce(*[body[s] for s in SECTIONS]).isNull()

    def whole(d: Column) -> Column:
        gathered = F.concat(*[F.transform(d[p], lambda x: x.error) for p in parts], F.array(d.act.error))
        errors = F.when(none, F.array(F.lit("no section headers"))).otherwise(F.filter(gathered, lambda e: e.isNotNull()))
        return F.struct(*[d[n].alias(n) for n in parts], d.act.lateral.alias("selected_lateral"), d.act.longitudinal.alias("selected_longitudinal"), errors.alias("errors"))

    return let(F.struct(*[c.alias(n) for n, c in parts.items()], action(body["ACTION"]).alias("act")), whole)


def to_text(doc: Column) -> Column:
    """The document printed; parsing it again gives the same struct."""
    line = lambda e: F.concat(
        e.id, F.lit(" = "), e.entity_type, F.lit(" {"), F.array_join(F.transform(F.map_entries(e.attributes), lambda a: F.concat(a.key, F.lit(": "), a.value)), ", "), F.lit("}")
    )
    condition = lambda c: F.concat(F.when(c.expected, F.lit("")).otherwise("NOT "), c["name"])
    return F.concat(
        F.lit("PERCEPTION:\n"),
        F.array_join(F.transform(doc.entities, line), "\n"),
        F.lit("\nOPERATIONS:\n"),
        F.array_join(F.transform(doc.operations, lambda o: F.concat(o.expression, F.lit(" = "), o.result)), "\n"),
        F.lit("\nFACTS:\n"),
        F.array_join(F.transform(doc.facts, lambda f: F.concat(f["name"], F.lit(" = "), F.when(f["value"], "True").otherwise("False"))), "\n"),
        F.lit("\nRULES:\n"),
        F.array_join(F.transform(doc.rules, lambda r: F.concat(F.array_join(F.transform(r.conditions, condition), " AND "), F.lit(" -> "), r.lateral, F.lit(", "), r.longitudinal)), "\n"),
        F.lit("\nACTION:\n"),
        doc.selected_lateral,
        F.lit(", "),
        doc.selected_longitudinal,
    )


# ------------------------------------------------------------------ validation
def _repeats(names: Column) -> Column:
    return F.filter(names, lambda n, i: F.exists(F.slice(names, 1, i), lambda o: o == n) & (i > 0))


def _class_of(a: Column, vocab: Vocabulary) -> Column:
    out = a
    for n, group in enumerate(vocab.same):
        out = F.when(a.isin(*group), F.lit(f"\x00{n}")).otherwise(out)
    return out


def violations(doc: Column, vocab: Vocabulary) -> Column:
    """array of texts, one for each rule of the format that the document breaks."""
    say = lambda what, xs: F.transform(xs, lambda x: F.concat(F.lit(f"{what}: "), x))
    allowed = {b: {a: F.array(*map(F.lit, v)) for a, v in attrs.items()} for b, attrs in vocab.attributes.items()}

    def bad_attributes(e: Column) -> Column:
        def wrong(kv: Column) -> Column:
            ok = F.lit(False)
            for base, attrs in allowed.items():
                for name, values in attrs.items():
                    ok = ok | ((e.base_type == base) & (kv.key == name) & F.array_contains(values, kv.value))
            return ~F.coalesce(ok, F.lit(False))

        return F.transform(F.filter(F.map_entries(e.attributes), wrong), lambda kv: F.concat(e.id, F.lit("."), kv.key, F.lit("="), kv.value))

    names = F.transform(doc.facts, lambda f: f["name"])
    ids = F.transform(doc.entities, lambda e: e.id)
    known = F.array(*map(F.lit, sorted(vocab.facts)))
    queried = F.transform(F.filter(doc.operations, lambda o: o.op_type == "Query"), lambda o: F.trim(F.regexp_extract(o.expression, r"\(\s*([^,.)]+)", 1)))
    used = F.flatten(F.transform(doc.rules, lambda r: r.conditions))
    actions = F.concat(F.transform(doc.rules, lambda r: F.struct(r.lateral.alias("a"), r.longitudinal.alias("b"))), F.array(F.struct(doc.selected_lateral.alias("a"), doc.selected_longitudinal.alias("b"))))
    matches = F.exists(
        doc.rules, lambda r: (r.lateral == doc.selected_lateral) & (_class_of(r.longitudinal, vocab) == _class_of(doc.selected_longitudinal, vocab))
    )
    return F.concat(
        say("duplicate entity", _repeats(ids)),
        say("bad attribute", F.flatten(F.transform(doc.entities, bad_attributes))),
        say("unknown queried entity", F.filter(queried, lambda q: ~F.array_contains(ids, q))),
        say("duplicate fact", _repeats(names)),
        say("unknown fact", F.filter(names, lambda n: ~F.array_contains(known, n))),
        # a condition that must hold needs its fact listed, whatever its value; one that must not hold may be absent
        say("rule on unlisted fact", F.transform(F.filter(used, lambda c: c.expected & ~F.array_contains(names, c["name"])), lambda c: c["name"])),
        say("unknown lateral action", F.transform(F.filter(actions, lambda x: ~x.a.isin(*vocab.lateral)), lambda x: x.a)),
        say("unknown longitudinal action", F.transform(F.filter(actions, lambda x: ~x.b.isin(*vocab.longitudinal)), lambda x: x.b)),
        F.when((F.size(doc.rules) > 0) & ~matches, F.array(F.lit("action of no rule"))).otherwise(F.array().cast("array<string>")),
    )


def action_consistent(doc: Column) -> Column:
    """Whether a rule has exactly the selected actions."""
    return F.exists(doc.rules, lambda r: (r.lateral == doc.selected_lateral) & (r.longitudinal == doc.selected_longitudinal))


# ------------------------------------------------------------------ grounding
def _ego_says(operations: Column, attribute: str) -> Column:
    """What the last EgoQuery on an attribute says; null if there is none."""
    own = F.filter(operations, lambda o: (o.op_type == "EgoQuery") & (F.regexp_extract(o.expression, r"^EgoQuery\((\w+)\)", 1) == attribute))
    return F.try_element_at(own, F.lit(-1)).result


def condition_holds(doc: Column, c: Condition) -> Column:
    """Does a document satisfy a condition: EXISTS over its entities, NOT EXISTS for no_entity, the ego vehicle's queried state for ego."""
    if c.kind == "judgment":
        return F.lit(True)
    if c.kind == "ego":
        ok = F.lit(bool(c.equals))
        for k, v in c.equals.items():
            ok = ok & F.coalesce(_ego_says(doc.operations, k) == v, F.lit(False))
        return ok

    def match(e: Column) -> Column:
        ok = e.base_type == c.base_type
        if c.subtype:
            ok = ok & (e.entity_type == c.subtype)
        for k, v in c.equals.items():
            ok = ok & (F.try_element_at(e.attributes, F.lit(k)) == v)
        for k, vs in c.among.items():
            ok = ok & F.try_element_at(e.attributes, F.lit(k)).isin(*vs)
        return F.coalesce(ok, F.lit(False))

    hit = F.exists(doc.entities, match)
    return ~hit if c.kind == "no_entity" else hit


def fact_holds(doc: Column, conditions: tuple[Condition, ...]) -> Column:
    """Whether any of a fact's conditions holds; none does for a fact without conditions."""
    holds = F.lit(False)
    for c in conditions:
        holds = holds | condition_holds(doc, c)
    return holds


def grounding(doc: Column, vocab: Vocabulary) -> Column:
    """(grounding_score, ungrounded_facts, judgment_facts) over the facts that are said to be true and that the vocabulary defines.

    A fact that is a matter of judgment counts as grounded.  Each fact of the vocabulary is evaluated once a document,
    however many facts the document lists.
    """
    names = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    judged = sorted(n for n, conditions in vocab.facts.items() if any(c.kind == "judgment" for c in conditions))
    holding = [F.when(fact_holds(doc, conditions), F.lit(n)) for n, conditions in sorted(vocab.facts.items()) if n not in judged]
    true = F.transform(F.filter(doc.facts, lambda f: F.coalesce(f["value"], F.lit(False))), lambda f: f["name"])
    said = F.filter(true, lambda n: F.array_contains(names(sorted(vocab.facts)), n))
    grounded = F.concat(F.array_compact(F.array(*holding)) if holding else names([]), names(judged))

    def score(s: Column) -> Column:
        missing = F.filter(s.said, lambda n: ~F.array_contains(s.grounded, n))
        n = F.size(s.said)
        return F.struct(
            F.when(n == 0, 1.0).otherwise(F.try_divide((n - F.size(missing)).cast("double"), n)).alias("grounding_score"),
            missing.alias("ungrounded_facts"),
            F.filter(s.said, lambda x: F.array_contains(names(judged), x)).alias("judgment_facts"),
        )

    return let(F.struct(said.alias("said"), grounded.alias("grounded")), score)


def stage_completeness(doc: Column) -> Column:
    return (F.size(doc.entities) > 0).cast("int") / 4 + (F.size(doc.operations) > 0).cast("int") / 4 + (F.size(doc.facts) > 0).cast("int") / 4 + (F.size(doc.rules) > 0).cast("int") / 4


def phrase_to_symbols(phrase: Column, lateral: list[tuple[str, str]], longitudinal: list[tuple[str, str]], defaults: tuple[str, str] = ("KeepLane", "ConstantSpeed")) -> Column:
    """Free action text to symbols: the first lateral prefix and the first longitudinal part that match; empty and STOP stand still."""
    low = F.lower(F.trim(phrase))
    lat, lon = F.lit(defaults[0]), F.lit(defaults[1])
    for text, symbol in reversed(lateral):
        lat = F.when(F.startswith(low, F.lit(text)), symbol).otherwise(lat)
    for text, symbol in reversed(longitudinal):
        lon = F.when(F.contains(low, F.lit(text)), symbol).otherwise(lon)
    still = low.isin("", "stop")
    return F.struct(F.when(still, "KeepLane").otherwise(lat).alias("lateral"), F.when(still, "Stop").otherwise(lon).alias("longitudinal"))
