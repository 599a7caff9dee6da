"""Semi-naive saturation of EL axioms and assertions with DataFrame joins.

State: sub(x, c), x is in (or, for contexts, below) c; and link(x, r, y). A context stands
for any element of a class, or for any successor by some roles in a set of classes; it is
shared by all who need just these, and its name begins with ``CONTEXT``. All other names
are individuals. Rule tables:

=========  ==============  ==========================================
told       (c, d)          C below D
conj       (a, b, e)       A and B below E
some       (r, c, e)       some r C below E
give       (c, r, d)       C below some r D: a link to the context of (r, D)
value      (c, r, y)       C below the value y of r: a link to the individual y
role       (r, s)          r below s
chain      (r1, r2, s)     r1 after r2 below s; transitive roles too
inverse    (r, s)          y s x for x r y
domain     (r, e)          x in E for x r y
range      (r, e)          y in E for x r y
all        (c, r, e)       y in E for x in C, x r y
apart      (g, pos, c)     classes of one group are disjoint, position by position
loop       (c, r)          x r x for x in C
self       (r, e)          x in E for x r x
single     (r)             r is functional: a context's successors by it are one
top        (any rows)      everything is in TOP
bottom     (any rows)      emptiness travels back along links
=========  ==============  ==========================================

What a link says about its target holds for individuals, and for the one who has the link.
So where a rule tells more of a successor than its context knows (``all``, the range of a
role that chains make, or two successors by a functional role), the link leads on to a
context with more classes. Contexts are made as rules need them, one for each set. Inverse
roles need no links back from contexts: an existential over the inverse is a universal, and
the other way round. ``open_ends`` finds what contexts would need beyond that.

Every round applies all rules to what the last round added, joined with the whole state
where a rule needs two facts, and keeps what is new. Ends when nothing is new.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.components import checkpoint

TOP, NOTHING = "owl:Thing", "owl:Nothing"
#: First character of the names of contexts; no IRI or blank node begins with it.
CONTEXT = "\x01"
#: Between the roles and the classes of a context's name, and between roles.
SEP, AND = "\x02", "\x03"
#: Rounds after which the state is written anew, dealt by x.
COMPACT = 6
#: Rows of the largest rule table that joins broadcast: some 20 MB.
SMALL = 200_000
_SUB, _LINK = ["x", "c"], ["x", "r", "y"]


def context(c: Column, r: Column | None = None) -> Column:
    """Name of the context of a class, or of the r-successors in a class."""
    return F.concat(F.lit(CONTEXT), c) if r is None else F.concat(F.lit(CONTEXT), r, F.lit(SEP), c)


def _roles(x: Column) -> Column:
    return F.split(F.substring_index(F.substring(x, 2, 1 << 30), SEP, 1), AND)


def _classes(x: Column) -> Column:
    """Classes that a context of successors is made with."""
    return F.slice(F.split(x, SEP), 2, 1 << 30)


def joint(roles: Column, classes: Column) -> Column:
    """Name of the context of successors by all of the roles in all of the classes (arrays)."""
    return F.concat(F.lit(CONTEXT), F.array_join(F.array_sort(F.array_distinct(roles)), AND), F.lit(SEP), F.array_join(F.array_sort(F.array_distinct(classes)), SEP))


def is_context(x: Column) -> Column:
    return x.startswith(CONTEXT)


def _named(link: DataFrame) -> DataFrame:
    return link.where(~is_context(F.col("x")) & ~is_context(F.col("y")))


def _union(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, parts) if parts else None


def above(pairs: DataFrame) -> DataFrame:
    """(r, s): reflexive and transitive closure of a role hierarchy (r, s)."""
    own = pairs.select("r").union(pairs.select("s")).select("r", F.col("r").alias("s"))
    state = checkpoint(pairs.select("r", "s").union(own).distinct())
    while True:
        far = state.join(state.select(F.col("r").alias("s"), F.col("s").alias("t")), "s").select("r", F.col("t").alias("s")).distinct()
        new = checkpoint(far.join(state, ["r", "s"], "left_anti"))
        if new.isEmpty():
            return state
        state = checkpoint(state.union(new))


def _subs(rules: Mapping[str, DataFrame], sub: DataFrame, link: DataFrame, new_sub: DataFrame, new_link: DataFrame, first: bool) -> list[DataFrame]:
    made = []
    if "told" in rules:
        made.append(new_sub.join(rules["told"], "c").select("x", F.col("d").alias("c")))
    if "conj" in rules:
        for one, other in (("a", "b"),) if first else (("a", "b"), ("b", "a")):
            half = new_sub.join(rules["conj"], F.col("c") == F.col(one)).select("x", F.col(other).alias("c"), "e")
            made.append(half.join(sub, ["x", "c"]).select("x", F.col("e").alias("c")))
    if "apart" in rules:
        apart = rules["apart"]
        met = new_sub.join(apart.select("c").distinct(), "c", "left_semi").select("x").distinct()
        held = sub.join(apart, "c").join(met, "x", "left_semi").groupBy("x", "g").agg(F.count_distinct("pos").alias("n"))
        made.append(held.where("n > 1").select("x", F.lit(NOTHING).alias("c")))
    if "some" in rules:
        some = rules["some"]
        roles = some.select("r").distinct()
        ahead = new_link.join(some, "r").select("x", F.col("y"), F.col("c").alias("need"), "e")
        target = sub.select(F.col("x").alias("y"), F.col("c").alias("need"))
        made.append(ahead.join(target, ["y", "need"]).select("x", F.col("e").alias("c")))
        if not first:
            behind = new_sub.join(some, "c").select(F.col("x").alias("y"), "r", "e")
            made.append(behind.join(link.join(roles, "r", "left_semi"), ["y", "r"]).select("x", F.col("e").alias("c")))
    if "domain" in rules:
        made.append(new_link.join(rules["domain"], "r").select("x", F.col("e").alias("c")))
    if "range" in rules:
        made.append(_named(new_link).join(rules["range"], "r").select(F.col("y").alias("x"), F.col("e").alias("c")))
    if "self" in rules:
        made.append(_named(new_link).where("x = y").join(rules["self"], "r").select("x", F.col("e").alias("c")))
    if "all" in rules:
        every = rules["all"]
        ahead = _named(new_link).join(every, "r").select("x", "c", "y", "e")
        made.append(ahead.join(sub, ["x", "c"]).select(F.col("y").alias("x"), F.col("e").alias("c")))
        if not first:
            members = new_sub.join(every, "c").select("x", "r", "e")
            made.append(members.join(_named(link), ["x", "r"]).select(F.col("y").alias("x"), F.col("e").alias("c")))
    if "give" in rules:
        made_at = new_link.where(F.col("y").contains(SEP)).select(F.col("y").alias("x")).distinct()
        made.append(made_at.select("x", F.explode(F.array_append(_classes(F.col("x")), F.lit(TOP)) if "top" in rules else _classes(F.col("x"))).alias("c")))
        if "ranges" in rules:
            made.append(made_at.select("x", F.explode(_roles(F.col("x"))).alias("r")).join(rules["ranges"], "r").select("x", F.col("e").alias("c")))
    if "compose" in rules:  # paths of told classes double: the contexts of classes know what is above these
        known = new_sub if "even" in rules else sub
        known = known.where(~F.col("x").contains(SEP) & is_context(F.col("x"))).select(F.substring("x", 2, 1 << 30).alias("c"), F.col("c").alias("d"))
        made.append(new_sub.join(known, "c").select("x", F.col("d").alias("c")))
    if "bottom" in rules:
        empty = new_sub.where(F.col("c") == NOTHING).select(F.col("x").alias("y"))
        made.append(link.join(empty, "y", "left_semi").select("x", F.lit(NOTHING).alias("c")))
        full = sub.where(F.col("c") == NOTHING).select(F.col("x").alias("y"))
        made.append(new_link.join(full, "y", "left_semi").select("x", F.lit(NOTHING).alias("c")))
    return made


def _links(rules: Mapping[str, DataFrame], link: DataFrame, new_sub: DataFrame, new_link: DataFrame, first: bool) -> list[DataFrame]:
    made = []
    if "give" in rules:
        made.append(new_sub.join(rules["give"], "c").select("x", "r", context(F.col("d"), F.col("r")).alias("y")))
    if "value" in rules:
        made.append(new_sub.join(rules["value"], "c").select("x", "r", "y"))
    if "loop" in rules:
        made.append(new_sub.join(rules["loop"], "c").select("x", "r", F.col("x").alias("y")))
    if "role" in rules:
        made.append(new_link.join(rules["role"], "r").select("x", F.col("s").alias("r"), "y"))
    if "inverse" in rules:
        made.append(_named(new_link).join(rules["inverse"], "r").select(F.col("y").alias("x"), F.col("s").alias("r"), F.col("x").alias("y")))
    if "chain" in rules:
        for left, right in ((new_link, link),) if first else ((new_link, link), (link, new_link)):
            one = left.select("x", F.col("r").alias("r1"), F.col("y").alias("mid")).join(rules["chain"], "r1")
            other = right.select(F.col("x").alias("mid"), F.col("r").alias("r2"), "y")
            made.append(one.join(other, ["mid", "r2"]).select("x", F.col("s").alias("r"), "y"))
    return made


def _further(rules: Mapping[str, DataFrame], sub: DataFrame, link: DataFrame, new_sub: DataFrame, new_link: DataFrame, first: bool) -> list[DataFrame]:
    """Links to contexts that know more of a successor than the one that it has."""
    made, unnamed = [], F.col("y").contains(SEP)
    if "every" in rules:
        told = [new_link.where(unnamed).join(rules["every"], "r").join(sub, ["x", "c"]).select("x", "r", "y", "e")]
        if not first:
            told.append(new_sub.join(rules["every"], "c").select("x", "r", "e").join(link.where(unnamed), ["x", "r"]).select("x", "r", "y", "e"))
        lacking = _union(told).distinct().join(sub.select(F.col("x").alias("y"), F.col("c").alias("e")), ["y", "e"], "left_anti")
        # every link of the pair by a role below the one that tells
        below = rules["higher"].select(F.col("r").alias("q"), F.col("s").alias("r"))
        lacking = lacking.join(below, "r").join(link.select("x", F.col("r").alias("q"), "y"), ["x", "q", "y"]).groupBy("x", "q", "y").agg(F.collect_set("e").alias("more"))
        made.append(lacking.select("x", F.col("q").alias("r"), joint(_roles(F.col("y")), F.concat(_classes(F.col("y")), "more")).alias("y")))
    if "single" in rules and "give" in rules:
        met = new_link.where(unnamed).join(rules["single"], "r", "left_semi").select("x", "r").distinct()
        own = link.where(unnamed).join(met, ["x", "r"], "left_semi")
        whole = own.groupBy("x", F.col("r").alias("f")).agg(F.flatten(F.collect_set(_roles(F.col("y")))).alias("roles"), F.flatten(F.collect_set(_classes(F.col("y")))).alias("classes"), F.count_distinct("y").alias("n"))
        whole = whole.where("n > 1").select("x", "f", joint(F.col("roles"), F.col("classes")).alias("to"))
        below = rules["higher"].select("r", F.col("s").alias("f"))
        made.append(link.where(unnamed).join(below, "r").join(whole, ["x", "f"]).select("x", "r", F.col("to").alias("y")).distinct())
    return made


def _new(parts: list[DataFrame], state: DataFrame, columns: list[str]) -> DataFrame | None:
    found = _union([p.select(*columns) for p in parts])
    return None if found is None else checkpoint(found.distinct().join(state, columns, "left_anti"))


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df``, marked for broadcasting if a count shows that it has ``most`` rows or fewer."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _prepared(rules: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The rules, and what follows from them alone: ranges of the roles above a role, universals and
    existentials over inverse roles, and ranges of loops."""
    rules = dict(rules)
    tell = [rules[k].select("r") for k in ("all", "single", "range") if k in rules]
    if not ({"give", "loop"} & set(rules)) or not tell and "some" not in rules:
        return rules
    pairs = [_union(tell + ([rules["some"].select("r")] if "some" in rules else [])).select("r", F.col("r").alias("s"))]
    if "role" in rules:
        pairs.append(rules["role"].select("r", "s"))
    if "inverse" in rules:
        pairs += [rules["inverse"].select("r", F.col("r").alias("s")), rules["inverse"].select("s", F.col("s").alias("s2")).toDF("r", "s")]
    higher = rules["higher"] = small(above(_union(pairs)))
    every = [rules["all"].select("c", "r", "e")] if "all" in rules else []
    if "inverse" in rules and "some" in rules:
        back = rules["inverse"].join(higher.toDF("s", "up"), "s")
        every.append(back.join(rules["some"].select(F.col("r").alias("up"), "c", "e"), "up").select("c", "r", "e"))
    if "inverse" in rules and "all" in rules:
        back = rules["inverse"].join(higher.toDF("s", "up"), "s")
        more = back.join(rules["all"].select(F.col("r").alias("up"), "c", "e"), "up").select("r", "c", "e")
        rules["some"] = small(checkpoint((rules["some"].select("r", "c", "e").union(more) if "some" in rules else more).distinct()))
    if "range" in rules:
        ranges = higher.join(rules["range"].select(F.col("r").alias("s"), "e"), "s").select("r", "e").distinct()
        rules["ranges"] = small(checkpoint(ranges))
        if "loop" in rules:
            looped = rules["loop"].join(rules["ranges"], "r").select("c", F.col("e").alias("d"))
            rules["told"] = small(checkpoint((rules["told"].select("c", "d").union(looped) if "told" in rules else looped).distinct()))
        if "chain" in rules:
            every.append(rules["chain"].select(F.col("s").alias("r")).distinct().join(rules["ranges"], "r").select(F.lit(TOP).alias("c"), "r", "e"))
    if every:
        rules["every"] = small(checkpoint(_union(every).distinct()))
    return rules


def _even(rules: Mapping[str, DataFrame], sub: DataFrame) -> bool:
    """Whether all told classes start together and nothing else is told, so that every round doubles all paths:
    one of n steps, more than half of the next round's, is two that the last round found or one and a told step."""
    if set(rules) != {"told", "compose"}:
        return False
    own = sub.where(is_context(F.col("x")))
    return own.where(F.col("x") != context(F.col("c"))).isEmpty() and rules["told"].select("c").join(own.select("c"), "c", "left_anti").isEmpty()


def saturate(sub: DataFrame, link: DataFrame, rules: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All facts sub(x, c) and link(x, r, y) that follow; rules that are absent are skipped.

    Facts are sets. Null parts of facts are left out. Classes and contexts are finite in number, so
    this ends.
    """
    rules = _prepared(rules)
    link = checkpoint(link.select(*_LINK).na.drop().distinct())
    sub = sub.select(*_SUB).na.drop()
    if "top" in rules:
        every = sub.select("x").union(link.select("x")).union(link.select("y"))
        if "value" in rules:
            every = every.union(rules["value"].select("y"))
        sub = sub.union(every.select("x", F.lit(TOP)))
    sub = checkpoint(sub.distinct())
    if "told" in rules and not sub.where(is_context(F.col("x"))).isEmpty():
        rules["compose"] = rules["told"]
        if _even(rules, sub):
            rules["even"] = rules["told"]
    new_sub, new_link, turn = sub, link, 0
    while True:
        made_sub = _new(_subs(rules, sub, link, new_sub, new_link, turn == 0), sub, _SUB)
        made_link = _new(_links(rules, link, new_sub, new_link, turn == 0) + _further(rules, sub, link, new_sub, new_link, turn == 0), link, _LINK)
        done = True
        if made_sub is not None and not made_sub.isEmpty():
            sub, done = sub.union(made_sub), False
        if made_link is not None and not made_link.isEmpty():
            link, done = link.union(made_link), False
        if done:
            return sub, link
        if turn % COMPACT == COMPACT - 1:
            sub, link = checkpoint(sub.repartition("x")), checkpoint(link.repartition("x"))
        new_sub = made_sub if made_sub is not None else sub.limit(0)
        new_link = made_link if made_link is not None else link.limit(0)
        turn += 1


def not_closed(sub: DataFrame, link: DataFrame, rules: Mapping[str, DataFrame]) -> DataFrame:
    """(x, r, y) and (x, null, c): what the rules still give from a state; no rows at a fixpoint."""
    rules = _prepared(rules)
    subs = _union([p.select(*_SUB) for p in _subs(rules, sub, link, sub, link, False)])
    links = _union([p.select(*_LINK) for p in _links(rules, link, sub, link, False) + _further(rules, sub, link, sub, link, False)])
    parts = []
    if subs is not None:
        parts.append(subs.join(sub, _SUB, "left_anti").select("x", F.lit(None).cast("string").alias("r"), F.col("c").alias("y")))
    if links is not None:
        parts.append(links.join(link, _LINK, "left_anti"))
    return _union(parts).distinct() if parts else link.limit(0)


def open_ends(sub: DataFrame, link: DataFrame, rules: Mapping[str, DataFrame], functional: DataFrame, inverse_functional: DataFrame, exclusive: DataFrame) -> DataFrame:
    """(what): rules that contexts would need and that are not applied to them, as contexts are shared.

    While rows are found, what does not follow from the state may still follow from the
    axioms. functional, inverse_functional, exclusive: roles (r); the last are asymmetric,
    irreflexive or disjoint with others.
    """
    shared = link.where(is_context(F.col("x")) | is_context(F.col("y")))
    values = link.where(is_context(F.col("x")) & ~is_context(F.col("y")))
    found = []
    asked = [values.join(rules["all"], "r").join(sub, ["x", "c"]).select(F.lit("allValuesFrom").alias("what"), F.col("y").alias("x"), F.col("e").alias("c"))] if "all" in rules else []
    if "range" in rules:
        asked.append(values.join(rules["range"], "r").select(F.lit("range of a value").alias("what"), F.col("y").alias("x"), F.col("e").alias("c")))
    found += [a.join(sub, ["x", "c"], "left_anti").select("what") for a in asked]
    if "inverse" in rules:
        back = shared.select("r").distinct().join(rules["inverse"], "r").select(F.col("s").alias("r")).distinct()
        if "role" in rules:
            back = back.union(back.join(above(rules["role"].select("r", "s")), "r").select(F.col("s").alias("r"))).distinct()
        parts = [rules[k].select(c) for k, c in (("chain", "r1"), ("chain", "r2"), ("self", "r")) if k in rules]
        used = reduce(DataFrame.union, [functional.select("r"), inverse_functional.select("r"), *parts])
        found.append(back.join(used.distinct(), "r", "left_semi").select(F.lit("inverseOf").alias("what")))
    if "self" in rules:
        found.append(shared.where("x = y").join(rules["self"], "r", "left_semi").select(F.lit("hasSelf")))
    lone = shared.where(is_context(F.col("x"))).join(functional, "r", "left_semi")
    mixed = lone.groupBy("x", "r").agg(F.count_distinct("y").alias("n"), F.count_if(~is_context(F.col("y"))).alias("named")).where("n > 1 and named > 0")
    found.append(mixed.select(F.lit("FunctionalProperty").alias("what")))
    found.append(shared.where(~is_context(F.col("y"))).join(inverse_functional, "r", "left_semi").select(F.lit("InverseFunctionalProperty")))
    found.append(shared.join(exclusive, "r", "left_semi").select(F.lit("exclusive properties")))
    return reduce(DataFrame.union, found).distinct()
