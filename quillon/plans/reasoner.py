"""The questions that can be asked of an ontology: yes, no, or unknown (None)."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import values as V
from quillon.operators import constraints, taxonomy
from quillon.operators.components import checkpoint, representatives
from quillon.operators.saturation import CONTEXT, NOTHING, TOP, above, context, is_context, not_closed, open_ends, saturate
from quillon.plans import datatypes
from quillon.plans.ontology import NONE, OWL, Ontology, mapped
from quillon.plans.validity import violations
from quillon.sources import ntriples

#: Name of an individual that no graph has.
FRESH = "new:individual"


class Reasoner:
    """Answers over the saturated facts. What follows is final; what does not follow is
    "no" if every triple was taken up and no rule was left open, and unknown otherwise."""

    def __init__(self, ontology: Ontology) -> None:
        self.ontology = ontology
        self.spark: SparkSession = ontology.types.sparkSession

    @classmethod
    def from_triples(cls, triples: DataFrame) -> Reasoner:
        return cls(mapped(triples))

    @classmethod
    def from_ntriples(cls, spark: SparkSession, path: str) -> Reasoner:
        triples, wrong = ntriples.read(spark, path)
        bad = wrong.first()
        if bad is not None:
            raise ValueError(f"not N-Triples: {bad.line[:200]}")
        return cls.from_triples(triples)

    @cached_property
    def supported(self) -> bool:
        """Whether rules, facts and checks took up every triple."""
        return self.ontology.unsupported.isEmpty()

    def _settled(self, sub: DataFrame, link: DataFrame) -> bool:
        """Whether nothing is left that contexts would need."""
        o = self.ontology
        special = reduce(DataFrame.union, [o.traits["AsymmetricProperty"], o.traits["IrreflexiveProperty"], o.disjoint_roles.select("r")])
        return self.supported and open_ends(sub, link, o.rules, o.traits["FunctionalProperty"], o.traits["InverseFunctionalProperty"], special).isEmpty()

    @cached_property
    def classes(self) -> DataFrame:
        """(c): declared classes."""
        return self.ontology.entities.where("kind = 'Class'").select(F.col("iri").alias("c")).distinct()

    @cached_property
    def individuals(self) -> DataFrame:
        """(x) that facts name."""
        o = self.ontology
        named = [o.types.select("x"), o.links.select("x"), o.links.select("y"), o.values.select("x"), o.same.select("a"), o.same.select("b"), o.different.select("x"), o.denied.select("x"), o.denied.select("y"), o.denied_values.select("x")]
        named.append(o.entities.where("kind = 'NamedIndividual'").select(F.col("iri").alias("x")))
        if "value" in o.rules:
            named.append(o.rules["value"].select("y"))
        return checkpoint(reduce(DataFrame.union, named).distinct())

    @cached_property
    def _contexts(self) -> tuple[DataFrame, DataFrame]:
        """Saturated state of one context for each class and for owl:Thing, with the facts if axioms name individuals."""
        names = self.classes.union(self.spark.createDataFrame([(TOP,)], "c string"))
        own = names.select(context(F.col("c")).alias("x"), "c")
        if self.ontology.nominals:
            sub, link, _ = self.facts
            return saturate(sub.union(own), link, self.ontology.rules)
        return saturate(own, self.ontology.links.limit(0), self.ontology.rules)

    @cached_property
    def _classes_settled(self) -> bool:
        return self._settled(*self._contexts)

    def direct_parents(self) -> DataFrame:
        """(sub, sup) between the representatives of equivalent classes, without what follows from others."""
        return taxonomy.direct_parents(self.taxonomy)

    @cached_property
    def taxonomy(self) -> DataFrame:
        """(sub, sup): all subsumptions between named classes, the class itself left out."""
        sub, _ = self._contexts
        named = self.classes.union(self.spark.createDataFrame([(NOTHING,)], "c string"))
        own = self.classes.select(context(F.col("c")).alias("x"), F.col("c").alias("sub"))
        found = sub.join(own, "x").join(named, "c", "left_semi").where("sub <> c")
        return checkpoint(found.select("sub", F.col("c").alias("sup")))

    @cached_property
    def values(self) -> DataFrame:
        """(x, p, line, key, value_key): asserted values, and those of properties above."""
        own = self.ontology.values
        if self.ontology.data.empty:
            return own
        higher = self.ontology.data.below.where("p <> q")
        more = own.join(higher, "p").select("x", F.col("q").alias("p"), "line", "key", "value_key")
        return checkpoint(own.unionByName(more).distinct())

    @cached_property
    def facts(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Saturated types and links between representatives, and (x, rep)."""
        o, same = self.ontology, self.ontology.same
        given = o.types if o.data.empty else o.types.union(datatypes.data_types(o.data, self.values))
        types = checkpoint(given.union(self.individuals.select("x", F.lit(TOP))).distinct())
        functional, inverse = o.traits["FunctionalProperty"], o.traits["InverseFunctionalProperty"]
        sub, link = types, o.links
        while True:
            if same.isEmpty():
                reps = self.individuals.select("x", F.col("x").alias("rep"))
            else:
                reps = checkpoint(representatives(self.individuals, same))
            at = lambda df, c: df.join(reps.select(F.col("x").alias(c), F.col("rep").alias("_rep")), c, "left").withColumn(c, F.coalesce("_rep", c)).drop("_rep")  # noqa: E731, B023
            sub, link = saturate(at(sub, "x").select("x", "c"), at(at(link, "x"), "y").select("x", "r", "y"), o.rules)
            named = link.where(~is_context(F.col("x")) & ~is_context(F.col("y")))
            keyed = named.select("x", F.col("r").alias("p"), F.col("y").alias("value_key")).union(at(self.values, "x").select("x", "p", "value_key"))
            declared = sub.join(self._named_reps(reps), "x", "left_semi")
            found = [constraints.functional_same(named, functional), constraints.inverse_functional_same(named, inverse), constraints.keys_same(declared, keyed, o.keys), self._enumerated(sub)]
            more = checkpoint(reduce(DataFrame.union, found).where("a <> b").distinct())
            # the one successor of a functional role is the element that its context stands for
            unnamed = link.where(~is_context(F.col("x")) & is_context(F.col("y"))).join(functional, "r", "left_semi").select("x", "r", F.col("y").alias("at"))
            gained = named.join(unnamed, ["x", "r"]).select(F.col("y").alias("z"), "at").join(sub.withColumnRenamed("x", "at"), "at").select(F.col("z").alias("x"), "c")
            gained = checkpoint(gained.distinct().join(sub, ["x", "c"], "left_anti"))
            if more.isEmpty() and gained.isEmpty():
                return sub, link, reps
            same, sub = checkpoint(same.select("a", "b").union(more)), sub.union(gained)

    def _named_reps(self, reps: DataFrame) -> DataFrame:
        """(x): representatives of named individuals; keys see only these."""
        return reps.where(F.col("x").contains(":")).select(F.col("rep").alias("x")).distinct()

    def _enumerated(self, sub: DataFrame) -> DataFrame:
        """(a, b): members of the class of a single individual are that individual."""
        held = sub.where(F.col("c").startswith("one:") & ~is_context(F.col("x")))
        return held.select(F.substring("c", 5, 1 << 30).alias("a"), F.col("x").alias("b"))

    @cached_property
    def types(self) -> DataFrame:
        """(x, c) of named individuals."""
        sub, _, reps = self.facts
        named = sub.withColumnRenamed("x", "rep").join(reps, "rep").select("x", "c")
        return named.join(self.classes.union(self.spark.createDataFrame([(NOTHING,), (TOP,)], "c string")), "c", "left_semi").distinct()

    @cached_property
    def clashes(self) -> DataFrame:
        """(what, x): what makes the ontology inconsistent, and an individual or group that shows it."""
        o = self.ontology
        sub, link, reps = self.facts
        named = link.where(~is_context(F.col("x")) & ~is_context(F.col("y")))
        at = lambda df, c: df.join(reps.select(F.col("x").alias(c), F.col("rep").alias("_rep")), c, "left").withColumn(c, F.coalesce("_rep", c)).drop("_rep")
        values = at(self.values, "x")
        trait = lambda k: named.join(o.traits[k], "r", "left_semi")
        functional = values.join(o.traits["FunctionalProperty"].select(F.col("r").alias("p")), "p", "left_semi")
        denied = at(at(o.denied, "x"), "y")
        found = {
            "empty class": sub.where((F.col("c") == NOTHING) & ~is_context(F.col("x"))).select("x"),
            "different individuals": constraints.same_and_different(o.different, reps).select("rep"),
            "negative assertion": named.join(denied, ["x", "r", "y"], "left_semi").select("x"),
            "negative data assertion": values.join(at(o.denied_values, "x"), ["x", "p", "value_key"], "left_semi").select("x"),
            "irreflexive": constraints.loops(trait("IrreflexiveProperty")).select("x"),
            "asymmetric": constraints.both_ways(trait("AsymmetricProperty")).select("x"),
            "disjoint properties": constraints.role_group_clashes(named, o.disjoint_roles).select("x"),
            "disjoint data properties": constraints.role_group_clashes(values.select("x", F.col("p").alias("r"), F.col("value_key").alias("y")), o.disjoint_roles).select("x"),
            "functional data": constraints.functional_violations(functional.select(F.concat("p", F.lit(" "), "x").alias("x"), "value_key")).select("x"),
            "bottom property": o.triples.where(F.col("p").isin(NONE)).select("s"),
            "data range": values.select("x").limit(0) if o.data.empty else datatypes.outside_range(o.data, values),
        }
        parts = [df.select(F.lit(k).alias("what"), F.col(df.columns[0]).alias("x")) for k, df in found.items()]
        return checkpoint(reduce(DataFrame.union, parts).distinct())

    @cached_property
    def _empty_world(self) -> bool:
        """Whether owl:Thing is empty."""
        sub, _ = self._contexts
        return not sub.where((F.col("x") == CONTEXT + TOP) & (F.col("c") == NOTHING)).isEmpty()

    @cached_property
    def _facts_settled(self) -> bool:
        sub, link, _ = self.facts
        return self._settled(sub, link)

    def consistent(self) -> bool | None:
        if not self.clashes.isEmpty():
            return False
        if not self.individuals.isEmpty():  # these show all that could be wrong with owl:Thing
            return True if self._facts_settled else None
        if self._empty_world:
            return False
        return True if self._classes_settled else None

    def consistent_by_parts(self) -> DataFrame | None:
        """(component, size, consistent) of the assertions' parts; None if the axioms couple them."""
        o = self.ontology
        if not self.splittable:
            return None
        _, _, reps = self.facts
        edges = o.links.select(F.col("x").alias("a"), F.col("y").alias("b")).union(o.same.select("a", "b")).union(reps.select("x", "rep"))
        bad = self.clashes.where("what <> 'functional data'").select("x").union(self.clashes.where("what = 'functional data'").select(F.substring_index("x", " ", -1)))
        bad = bad.join(reps.select("x", "rep"), "x", "left").select(F.coalesce("rep", "x").alias("x")).union(bad)
        return constraints.by_parts(self.individuals, edges, bad)

    def still_open(self) -> DataFrame:
        """What the rules would still add to the facts; no rows at a fixpoint."""
        sub, link, _ = self.facts
        return not_closed(sub, link, self.ontology.rules)

    def _answer(self, found: bool, settled: bool) -> bool | None:
        if found or self.consistent() is False:
            return True
        return False if settled and self.consistent() else None

    def _fresh(self, name: str) -> Reasoner:
        """The ontology with a new individual in a class: rules on individuals go further than those on contexts."""
        return Reasoner(replace(self.ontology, types=self.ontology.types.union(self.spark.createDataFrame([(FRESH, name)], "x string, c string"))))

    def satisfiable(self, name: str) -> bool | None:
        if name in (TOP, OWL + "Thing"):
            return self.consistent()
        empty = not self.taxonomy.where((F.col("sub") == name) & (F.col("sup") == NOTHING)).isEmpty()
        found = self._answer(empty, self._classes_settled)
        return self._fresh(name).consistent() if found is None and self.supported else None if found is None else not found

    def subsumed(self, sub: str, sup: str) -> bool | None:
        if sub == sup or sup in (TOP, OWL + "Thing") or sub in (NOTHING, OWL + "Nothing"):
            return True
        held = self.taxonomy.where((F.col("sub") == sub) & F.col("sup").isin(sup, NOTHING))
        found = self._answer(not held.isEmpty(), self._classes_settled)
        return self._fresh(sub).instance_of(FRESH, sup) if found is None and self.supported else found

    @cached_property
    def splittable(self) -> bool:
        """Whether no axiom couples individuals of different parts of the assertions."""
        roles = self.ontology.links.select("r").distinct()
        return constraints.splittable(self.ontology.nominals, self.ontology.keys, roles, roles, OWL + "topObjectProperty")

    def part_of(self, individual: str) -> Reasoner:
        """The same axioms with the assertions of the individuals that links and equality connect with one.

        The way there is found from the individual outwards, so the rest of the assertions is neither
        partitioned nor saturated.
        """
        o = self.ontology
        pairs = o.links.select(F.col("x").alias("a"), F.col("y").alias("b")).union(o.same.select("a", "b")).union(o.denied.select("x", "y"))
        pairs = checkpoint(pairs.union(pairs.select("b", "a")).distinct())
        state = new = checkpoint(self.spark.createDataFrame([(individual,)], "x string"))
        while not new.isEmpty():
            ahead = pairs.join(F.broadcast(new) if new is state else new, F.col("a") == F.col("x")).select(F.col("b").alias("x")).distinct()
            new = checkpoint(ahead.join(state, "x", "left_anti"))
            state = checkpoint(state.union(new))
        own = lambda df: checkpoint(df.join(state, df[df.columns[0]] == state["x"], "left_semi"))
        different = o.different.join(state, "x", "left_semi").select("g", "pos", "x")
        entities = o.entities.join(state.select(F.col("x").alias("iri")), "iri", "left_anti").where("kind <> 'NamedIndividual'").select(*o.entities.columns)
        return Reasoner(replace(o, types=own(o.types), links=own(o.links), values=own(o.values), same=own(o.same), denied=own(o.denied), denied_values=own(o.denied_values), different=different, entities=entities))

    def instance_of(self, individual: str, name: str, by_part: bool = False) -> bool | None:
        """Whether the individual is in the class. ``by_part`` asks its own part of the assertions alone, if the
        axioms allow it; what does not follow there is "no" as far as the other parts are consistent."""
        if name in (TOP, OWL + "Thing"):
            return True
        if by_part and self.splittable:
            return self.part_of(individual).instance_of(individual, name)
        return self._answer(not self.types.where((F.col("x") == individual) & (F.col("c") == name)).isEmpty(), self._facts_settled)

    def instances(self, name: str) -> DataFrame:
        """(x) that are in the class, in order."""
        return self.types.where(F.col("c") == name).select("x").orderBy("x")

    def entails_link(self, x: str, r: str, y: str) -> bool | None:
        _, link, reps = self.facts
        near = lambda n, c: reps.where(F.col("x") == n).select(F.col("rep").alias(c))
        held = link.where(F.col("r") == r).join(near(x, "x"), "x", "left_semi").join(near(y, "y"), "y", "left_semi")
        return self._answer(not held.isEmpty(), self._facts_settled)

    def entails_value(self, x: str, p: str, lexical: str, datatype: str | None = None) -> bool | None:
        """Whether x has the value that a literal stands for."""
        _, _, reps = self.facts
        key = self.spark.createDataFrame([(lexical, datatype)], "lexical string, datatype string").select(V.place(F.col("datatype"), F.col("lexical"), F.lit(None).cast("string")).alias("at"))
        key = key.select(F.concat_ws(" ", "at.line", "at.key").alias("value_key"))
        same = reps.join(reps.where(F.col("x") == x).select("rep"), "rep").select("x")
        held = self.values.where(F.col("p") == p).join(key, "value_key", "left_semi").join(same, "x", "left_semi")
        return self._answer(not held.isEmpty(), self._facts_settled)

    def entails_same(self, a: str, b: str) -> bool | None:
        _, _, reps = self.facts
        held = a == b or reps.where(F.col("x").isin(a, b)).groupBy("rep").count().where("count = 2").count() == 1
        return self._answer(held, self._facts_settled)

    def _refuted(self, **more: DataFrame) -> bool | None:
        """Whether added facts make the ontology inconsistent."""
        found = Reasoner(replace(self.ontology, **more)).consistent()
        return None if found is None else not found

    def entails_different(self, a: str, b: str) -> bool | None:
        """Whether a and b are different: they can't be equal."""
        return self._refuted(same=self.ontology.same.union(self.spark.createDataFrame([(a, b)], "a string, b string")))

    def entails_denied(self, x: str, r: str, y: str) -> bool | None:
        """Whether x r y is excluded: the link would be a clash."""
        return self._refuted(links=self.ontology.links.union(self.spark.createDataFrame([(x, r, y)], "x string, r string, y string")))

    def answers(self, atoms: list[tuple[str, ...]]) -> DataFrame:
        """Bindings of a conjunctive query: atoms ("?x", class) or ("?x", role, "?y") over the facts; names
        without a question mark are individuals."""
        sub, link, reps = self.facts
        found = None
        for atom in atoms:
            rows = self.types.where(F.col("c") == atom[1]).select(F.col("x").alias("0")) if len(atom) == 2 else self._links_of(link, reps, atom[1])
            ends = [atom[0]] if len(atom) == 2 else [atom[0], atom[2]]
            for k, end in enumerate(ends):
                if not end.startswith("?"):
                    rows = rows.where(F.col(str(k)) == end)
            if len(ends) == 2 and ends[0] == ends[1]:
                rows = rows.where(F.col("0") == F.col("1"))
            rows = rows.select(*{e: F.col(str(k)).alias(e[1:]) for k, e in enumerate(ends) if e.startswith("?")}.values()).distinct()
            shared = [] if found is None else [c for c in rows.columns if c in found.columns]
            if found is not None and not shared:
                raise ValueError(f"{atom} shares no variable with the atoms before it")
            found = rows if found is None else found.join(rows, shared)
        return found.distinct()

    @staticmethod
    def _links_of(link: DataFrame, reps: DataFrame, r: str) -> DataFrame:
        own = link.where(F.col("r") == r)
        left, right = reps.select(F.col("x").alias("0"), F.col("rep").alias("x")), reps.select(F.col("x").alias("1"), F.col("rep").alias("y"))
        return own.join(left, "x").join(right, "y").select("0", "1")

    def violations(self) -> DataFrame:
        """(check_no, check_name, evidence) of everything that OWL 2 DL rules out, in the order of the checks."""
        return violations(self.ontology)

