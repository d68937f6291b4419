"""The rename table: class matching to a fixpoint, then members (X1, J16, J22-J28, X-s5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.grammar import edit_similarity, fixed
from . import similarity
from .store import stored

SAME_PACKAGE = 1.0
OTHER_PACKAGE = 0.9
THRESHOLD = 0.5


def rewritten(descs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows (desc, whole, missed) of distinct ``descs(desc)``: the class names inside renamed by ``mapping(from, to)``.

    A descriptor is cut at its class references, which are looked up by join, and put together
    again, so the mapping may be of any size.  Names without an entry stay, and are in ``missed``.
    """
    # pieces alternate: text outside references, then the name inside L...;
    pieces = descs.select("desc", F.posexplode(F.split(F.regexp_replace("desc", r"L([^;]+);", "\u0001L\u0002$1\u0001;"), "\u0001", -1)).alias("at", "piece"))
    named = pieces.withColumn("name", F.when(F.col("piece").startswith("L\u0002"), F.substr("piece", F.lit(3))))
    met = named.join(mapping.select(F.col("from").alias("name"), F.col("to").alias("_to")), "name", "left")
    text = F.when(F.col("name").isNotNull(), F.concat(F.lit("L"), F.coalesce("_to", "name"))).otherwise(F.col("piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", text.alias("t")))), lambda x: x["t"]), "")
    return met.groupBy("desc").agg(whole.alias("whole"), F.collect_set(F.when(F.col("_to").isNull(), F.col("name"))).alias("missed"))


def canonical_desc(members: DataFrame, mapping: DataFrame) -> DataFrame:
    """``members`` with the class names inside ``desc`` renamed by ``mapping(from, to)``.

    Names without an entry stay.  An unterminated class reference ends with an error.
    """
    bad = ~F.col("desc").rlike(r"^(?:[^L]|L[^;]+;)*$")
    descs = members.select("desc").distinct().withColumn("desc", F.when(bad, F.raise_error(F.concat(F.lit("unterminated class reference in "), "desc"))).otherwise(F.col("desc")))
    whole = rewritten(descs, mapping).select("desc", F.col("whole").alias("_new"))
    return members.drop("_new").join(whole, "desc").withColumn("desc", F.col("_new")).drop("_new")


def _best_groups(pairs: DataFrame, mine: DataFrame, theirs: DataFrame, near: float, far: float, threshold: float) -> DataFrame:
    """For each (set, package) of one side the groups of the other side with the best score: (set, pkg, other, same, score, overlap, jaccard).

    ``pairs(set, other, overlap, jaccard)``; ``mine`` and ``theirs`` are (set, pkg, name, owner).  A group is the owners
    of a set that are in the package (same), or those that are not.
    """
    groups = theirs.groupBy(F.col("set").alias("other"), "pkg").agg(F.count("*").alias("n"))
    all_ = groups.groupBy("other").agg(F.sum("n").alias("all"))
    met = mine.select("set", "pkg").distinct().join(pairs, "set").join(all_, "other").join(groups, ["other", "pkg"], "left")
    inside = F.coalesce("n", F.lit(0))
    ways = F.array_compact(F.array(F.when(inside > 0, F.struct(F.lit(True).alias("same"), (F.col("jaccard") * near).alias("score"))), F.when(F.col("all") > inside, F.struct(F.lit(False).alias("same"), (F.col("jaccard") * far).alias("score")))))
    rows = met.select("set", "pkg", "other", "overlap", "jaccard", F.explode(ways).alias("w")).select("set", "pkg", "other", "overlap", "jaccard", "w.*").where(F.col("score") > threshold)
    best = rows.groupBy("set", "pkg").agg(F.max("score").alias("_s"))
    return rows.join(best, ["set", "pkg"]).where("score = _s").drop("_s")


def _suffixes(side: DataFrame) -> DataFrame:
    """``side`` with a row for each suffix of the name, the empty one too."""
    return side.withColumn("k", F.explode(F.sequence(F.lit(0), F.length("name")))).withColumn("suffix", F.expr("right(name, k)"))


def _only_best(best: DataFrame, mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(owner, partner, score, overlap, jaccard) where one partner alone is best by score, common suffix and edit similarity.

    Suffixes are counted, not compared: for each suffix there is a count of the owners of a set that end in it,
    and of those in each package.  The longest suffix of a name that a best group has says which partners are
    left, and only these are looked at one by one.
    """
    index = _suffixes(theirs)
    inside = index.groupBy(F.col("set").alias("other"), "pkg", "suffix").agg(F.count("*").alias("n_in"))
    all_ = index.groupBy(F.col("set").alias("other"), "suffix").agg(F.count("*").alias("n_all"))
    asked = _suffixes(mine).join(best, ["set", "pkg"])
    met = asked.join(all_, ["other", "suffix"]).join(inside, ["other", "pkg", "suffix"], "left")
    n = F.when(F.col("same"), F.coalesce("n_in", F.lit(0))).otherwise(F.col("n_all") - F.coalesce("n_in", F.lit(0)))
    met = met.withColumn("n", n).where("n > 0")
    longest = met.groupBy("owner").agg(F.max("k").alias("k"))
    ties = met.join(longest, ["owner", "k"]).select("owner", "name", "pkg", "other", "same", "suffix", "score", "overlap", "jaccard")
    partner = index.select(F.col("set").alias("other"), "suffix", F.col("pkg").alias("_pkg"), F.col("name").alias("_name"), F.col("owner").alias("partner"))
    pairs = ties.join(partner, ["other", "suffix"]).where(F.col("same") == (F.col("pkg") == F.col("_pkg")))
    pairs = pairs.withColumn("edit", edit_similarity(F.col("name"), F.col("_name")))
    top = F.max_by(F.struct("partner", "score", "overlap", "jaccard"), "edit")
    # best and how many have it, in one pass: the second largest of two sorted aggregates would need the pairs again
    g = pairs.groupBy("owner").agg(F.max("edit").alias("_e"), top.alias("b"))
    ties_at_top = pairs.join(g.select("owner", "_e"), "owner").where("edit = _e").groupBy("owner").agg(F.count("*").alias("n")).where("n = 1")
    return g.join(ties_at_top, "owner", "left_semi").select("owner", "b.*")


def class_candidates(old: DataFrame, new: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows (from, to, score, overlap, jaccard, evidence) of classes that one snapshot has and the other lacks.

    Members (owner, kind, name, desc) are compared as sets; the similarity counts 0.85 times across
    packages and must exceed ``threshold``.  A pair is named if each side is the only best of the
    other by score, then length of the common suffix, then edit similarity of the simple names.

    Classes with equal sets are never paired with each other: scores are those of distinct sets and packages, and
    suffixes are looked up by their text, so n copies on either side cost n times the length of their names, plus the
    partners that share the longest suffix.
    """
    # members are hashed before they move
    tokens = lambda df: df.select(F.col("owner").alias("id"), F.md5(F.concat_ws(" ", "kind", "name", "desc").cast("binary")).alias("token"))
    gone, fresh = (tokens(a).join(b.select(F.col("owner").alias("id")).distinct(), "id", "left_anti") for a, b in ((old, new), (new, old)))
    pairs, members = similarity.set_pairs(gone, fresh, threshold=threshold)
    # no score is above its similarity, and owners of sets without a pair have no part in what follows
    pairs = stored(pairs.where(F.col("jaccard") > threshold))
    met = pairs.select(F.lit(0).alias("s"), F.col("a").alias("set")).unionByName(pairs.select(F.lit(1).alias("s"), F.col("b").alias("set"))).distinct()
    members = stored(members.join(met, ["s", "set"], "left_semi").select("s", "set", F.col("k").alias("owner"), S.package_of(F.col("k")).alias("pkg"), S.simple_name(F.col("k")).alias("name")))
    a, b = (members.where(F.col("s") == k).drop("s") for k in (0, 1))
    forth = _best_groups(pairs.withColumnsRenamed({"a": "set", "b": "other"}), a, b, 1.0, 0.85, threshold)
    back = _best_groups(pairs.withColumnsRenamed({"b": "set", "a": "other"}), b, a, 1.0, 0.85, threshold)
    l, r = _only_best(forth, a, b), _only_best(back, b, a)
    best = l.join(r.select(F.col("partner").alias("owner"), F.col("owner").alias("partner")), ["owner", "partner"])
    evidence = F.concat(F.lit("shares "), F.col("overlap").cast("string"), F.lit(" members, similarity "), fixed(F.col("jaccard")))
    return best.select(F.col("owner").alias("from"), F.col("partner").alias("to"), S.round_half_up(F.col("score"), 2).alias("score"), "overlap", "jaccard", evidence.alias("evidence"))


def merge_asserted_members(asserted: DataFrame, classes: DataFrame, derived: DataFrame, target: DataFrame) -> DataFrame:
    """Asserted member renames ``(owner, kind, from, to)`` with their new owner, score and agreement.

    The new owner is that of ``classes(from, to)``, or the old one.  One member of that name there
    scores 0.55 and gives its descriptor, several 0.4, none 0.1.
    """
    said = asserted.join(classes.select(F.col("from").alias("owner"), F.col("to").alias("_c")), "owner", "left").withColumn("to_owner", F.coalesce("_c", "owner")).drop("_c")
    there = target.groupBy(F.col("owner").alias("to_owner"), "kind", F.col("name").alias("to")).agg(F.count("*").alias("_n"), F.min("desc").alias("_d"))
    other = derived.groupBy("owner", "kind", "from").agg(F.collect_set("to").alias("_s"))
    met = said.join(there, ["to_owner", "kind", "to"], "left").join(other, ["owner", "kind", "from"], "left")
    n = F.coalesce("_n", F.lit(0))
    agreement = F.when(F.col("_s").isNull(), "alone").when(F.array_contains("_s", F.col("to")), "agrees").otherwise("disagrees")
    return met.select("owner", "kind", "from", "to_owner", "to", F.when(n == 1, F.col("_d")).alias("desc"), F.when(n == 1, 0.55).when(n > 1, 0.4).otherwise(0.1).alias("score"), agreement.alias("agreement"))


def match_classes(old: DataFrame, new: DataFrame, max_rounds: int = 10) -> DataFrame:
    """Rows (from, to, score, round) from members (owner, kind, name, desc) of two snapshots.

    Names on both sides are anchors (round 0, score 1).  Each round compares the classes that
    are left by the Jaccard similarity of their members, descriptors rewritten by the table so
    far, times 0.9 across packages; a pair enters the table if it is the strict mutual best by
    (score, name similarity) and reaches 0.5.  It ends when a round adds nothing.  Similarity
    alone never makes an entry more than a candidate.

    The first round compares all; a later one only the old classes with a descriptor that names a class
    matched in the round before, as no other similarity has changed.  Scored pairs are kept from round to
    round, without those of matched classes.  Tables of a round are written to the shared folder.
    """
    was, now = old.select(F.col("owner").alias("from")).distinct(), new.select(F.col("owner").alias("to")).distinct()
    found = stored(was.join(now, F.col("from") == F.col("to")).select("from", "to", F.lit(1.0).alias("score"), F.lit(0).alias("round")))
    left = stored(old.join(found.select(F.col("from").alias("owner")), "owner", "left_anti").select("owner", "kind", "name", "desc"))
    right = stored(new.join(found.select(F.col("to").alias("owner")), "owner", "left_anti").select("owner", "kind", "name", "desc"))
    names = F.filter(F.regexp_extract_all("desc", F.lit(r"L([^;]+);")), lambda x: x != "")
    refs = stored(left.select("owner", F.explode(names).alias("from")).distinct())
    token = F.concat_ws(" ", "kind", "name", "desc")
    tokens = lambda df: df.select(F.col("owner").alias("id"), token.alias("token")).distinct()
    package = F.when(S.package_of(F.col("l")) == S.package_of(F.col("r")), SAME_PACKAGE).otherwise(OTHER_PACKAGE)
    pairs, changed = None, left
    for n in range(1, max_rounds + 1):
        fresh_pairs = similarity.jaccard_pairs(tokens(canonical_desc(changed, found)), tokens(right), threshold=THRESHOLD)
        fresh_pairs = fresh_pairs.withColumn("score", F.col("jaccard") * package).withColumn("sim", S.name_similarity(S.simple_name(F.col("l")), S.simple_name(F.col("r")))).select("l", "r", "score", "sim")
        if pairs is not None:
            kept = pairs.join(changed.select(F.col("owner").alias("l")).distinct(), "l", "left_anti")
            fresh_pairs = kept.unionByName(fresh_pairs)
        pairs = stored(fresh_pairs)
        best = similarity.strict_mutual_best(pairs, "l", "r", ["score", "sim"]).where(F.col("score") >= THRESHOLD)
        fresh = stored(best.select(F.col("l").alias("from"), F.col("r").alias("to"), S.round_half_up(F.col("score"), 3).alias("score"), F.lit(n).alias("round")))
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
        gone, taken = fresh.select(F.col("from").alias("owner")), fresh.select(F.col("to").alias("owner"))
        left, right = left.join(gone, "owner", "left_anti"), right.join(taken, "owner", "left_anti")
        pairs = pairs.join(gone.withColumnRenamed("owner", "l"), "l", "left_anti").join(taken.withColumnRenamed("owner", "r"), "r", "left_anti")
        changed = stored(left.join(refs.join(fresh.select("from"), "from", "left_semi").select("owner").distinct(), "owner", "left_semi"))
    return found


def inner_agreement(matched: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Outer classes that all their matched inner classes place in one new outer class.

    ``matched(from, to)``; names of inner classes end in ``$Inner``.  ``left`` and ``right``
    have the outer names not matched yet, in a column ``owner``.
    """
    cut = r"^(.+)\$([^$]+)$"
    inner = matched.select(F.regexp_extract("from", cut, 1).alias("f"), F.regexp_extract("from", cut, 2).alias("fi"), F.regexp_extract("to", cut, 1).alias("t"), F.regexp_extract("to", cut, 2).alias("ti"))
    inner = inner.where("f <> '' and t <> '' and fi = ti").join(left.select(F.col("owner").alias("f")).distinct(), "f", "left_semi").join(right.select(F.col("owner").alias("t")).distinct(), "t", "left_semi")
    agreed = inner.groupBy("f").agg(F.min("t").alias("to"), F.max("t").alias("_m"), F.count("*").alias("n")).where("to = _m")
    first = agreed.groupBy("to").agg(F.min(F.struct("f", "n")).alias("x"))
    return first.select(F.col("x.f").alias("from"), "to", F.least(F.lit(0.95), 0.7 + 0.1 * F.col("x.n")).alias("score"), F.col("x.n").alias("n"))


def match_members(old: DataFrame, new: DataFrame, classes: DataFrame, target: DataFrame) -> DataFrame:
    """Rows (owner, kind, desc, from, to, score) of members renamed inside matched classes.

    Names that survive on the other side are out.  Inside a block of owner, kind and canonical
    descriptor the strict mutual best on name similarity is taken, at 0.5 or more.
    """
    moved = canonical_desc(old, classes).join(classes.select(F.col("from").alias("owner"), F.col("to").alias("_to")), "owner").withColumn("owner", F.col("_to")).drop("_to")
    key, name = ["owner", "kind", "desc"], ["owner", "kind", "name"]
    a, b = moved.select(*key, "name").distinct().join(new, name, "left_anti"), new.select(*key, "name").distinct().join(moved, name, "left_anti")
    met = a.withColumnRenamed("name", "from").join(b.withColumnRenamed("name", "to"), key)
    met = met.withColumn("sim", S.name_similarity(F.col("from"), F.col("to"))).withColumn("l", F.struct(*key, "from")).withColumn("r", F.struct(*key, "to"))
    sole = met.groupBy(*key).agg((F.count("*") == 1).alias("unique"))
    frequency = target.groupBy("desc").agg(F.count("*").alias("f"))
    best = similarity.strict_mutual_best(met, "l", "r", ["sim"]).join(sole, key).join(frequency, "desc", "left")
    raw = S.member_score(F.col("unique"), F.coalesce("f", F.lit(1)), F.col("sim"))
    return best.withColumn("score", S.round_half_up(raw, 3)).where(raw >= THRESHOLD).select(*key, "from", "to", "score")


#: Fixed values of the pairing: a descriptor is common beyond the first, says nothing beyond the second.
COMMON, USELESS = 20, 100


def pair_members(removed: DataFrame, added: DataFrame, frequency: DataFrame, block: tuple[str, ...] = ("owner", "desc")) -> DataFrame:
    """Rows (block .., old_name, new_name, score): the sole removed member of a block with the sole added one.

    ``frequency(desc, f)``: how often a descriptor occurs; a common one scores 0.5 instead of 0.8, one that
    occurs too often gives no pair.
    """
    sole = lambda df, name: df.groupBy(*block).agg(F.count("*").alias("n"), F.min("name").alias(name)).where("n = 1").drop("n")
    met = sole(removed, "old_name").join(sole(added, "new_name"), list(block)).join(frequency, "desc").where(F.col("f") <= USELESS)
    return met.select(*block, "old_name", "new_name", F.when(F.col("f") > COMMON, 0.5).otherwise(0.8).alias("score"))


def best_of(entries: DataFrame, by: list[str], score: str, key: str) -> DataFrame:
    """The entry with the highest score for each target, ties by the least key."""
    best = entries.groupBy(*by).agg(F.min(F.struct((-F.col(score)).alias("o"), key, score)).alias("x"))
    return best.select(*by, f"x.{key}", F.col(f"x.{score}").alias("score"))


def merge_asserted(derived: DataFrame, asserted: DataFrame, old_names: DataFrame, new_names: DataFrame) -> DataFrame:
    """Derived and asserted class renames in one table, agreement noted on both.

    An asserted entry scores 0.1 if its target does not exist, 0.3 if its source survives and
    0.55 otherwise.
    """
    said = asserted.select("from", "to", "source").distinct()
    said = said.join(new_names.select(F.col("owner").alias("to"), F.lit(True).alias("_there")), "to", "left").join(new_names.select(F.col("owner").alias("from"), F.lit(True).alias("_lives")), "from", "left")
    said = said.join(old_names.select(F.col("owner").alias("from")), "from", "left_semi")
    score = F.when(F.col("_there").isNull(), 0.1).when(F.col("_lives").isNotNull(), 0.3).otherwise(0.55)
    other = derived.select("from", F.col("to").alias("_d"))
    note = lambda other_to: F.when(F.col(other_to).isNull(), "alone").when(F.col(other_to) == F.col("to"), "agrees").otherwise("disagrees")
    a = said.join(other, "from", "left").select("from", "to", score.alias("score"), F.concat(F.lit("oracle:"), "source").alias("provenance"), note("_d").alias("agreement"))
    back = said.groupBy("from").agg(F.collect_set("to").alias("_s"))
    b = derived.join(back, "from", "left").select("from", "to", "score", F.lit("derived").alias("provenance"),
        F.when(F.col("_s").isNull(), "alone").when(F.array_contains("_s", F.col("to")), "agrees").otherwise("disagrees").alias("agreement"))
    return b.unionByName(a)


def preferred(entries: DataFrame, by: list[str]) -> DataFrame:
    """The entry to use for each key: derived first, then score, provenance and target."""
    order = F.struct((F.col("provenance") != "derived").alias("a"), (-F.col("score")).alias("b"), "provenance", "to")
    return entries.groupBy(*by).agg(F.min(F.struct(order.alias("o"), "score")).alias("x")).select(*by, "x.o.to", "x.score", "x.o.provenance")
