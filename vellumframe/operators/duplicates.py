"""Exact and near duplicates, their groups and reports, and set comparisons of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..sources.shared import cut


def text_key(text: Column) -> Column:
    """Digest of the normal form; null for blank texts."""
    n = normalize(text)
    return F.when(n != "", F.sha2(n, 256))


def exact_dups(docs: DataFrame, id: str, text: str = "text", image: str | None = None) -> DataFrame:
    """Members of groups of two or more equal normal forms: id, group_id (smallest id), size, keep.

    With `image`, rows without text are equal by that hash; a row with text never equals one without. Sums by key, then
    a join back, so a group of any size costs a row a member.
    """
    key = text_key(F.col(text))
    if image:
        key = F.coalesce(F.concat(F.lit("t"), key), F.concat(F.lit("i"), F.col(image).cast("string")))
    keyed = docs.select(id, key.alias("_k")).filter("_k is not null")
    groups = keyed.groupBy("_k").agg(F.min(id).alias("group_id"), F.count("*").alias("size")).filter("size > 1")
    return keyed.join(groups, "_k").select(id, "group_id", "size", (F.col(id) == F.col("group_id")).alias("keep"))


def drop_duplicates_keep_first(docs: DataFrame, id: str, text: str = "text") -> DataFrame:
    return docs.join(exact_dups(docs, id, text).filter("not keep").select(id), id, "left_anti")


def dup_report_totals(groups: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """groups, members, found (members past the first) and to_remove over rows of exact_dups."""
    return groups.groupBy(*(by or [])).agg(F.sum(F.col("keep").cast("long")).alias("groups"), F.count("*").alias("members"), (F.count("*") - F.sum(F.col("keep").cast("long"))).alias("found"), F.sum((~F.col("keep")).cast("long")).alias("to_remove"))


def sign_hash(vector: Column, bits: int = 64) -> Column:
    """One bit per component, set where it is not negative, as a signed 64-bit number."""
    return sum((F.when(F.coalesce(vector[i], F.lit(-1.0)) >= 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(1, bits)), F.when(vector[0] >= 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))


def hamming_pairs(hashes: DataFrame, id: str, hash: str, most: int = 4, block: int = 256, every: bool = False) -> DataFrame:
    """Pairs (a, b, distance) of 64-bit hashes within `most` bits: two such agree on one of most + 1 bands.

    Equal hashes are represented by their smallest id, unless `every` row is to be paired. The members of a band's bucket are dealt to blocks and met block
    by block, so that no task holds a large bucket; a pair is reported in the first band it shares.
    """
    reps = hashes.select(F.col(id).alias("id"), F.col(hash).alias("h"))
    reps = reps if every else reps.groupBy("h").agg(F.min("id").alias("id"))
    edges = [64 * k // (most + 1) for k in range(most + 2)]
    part = lambda h, k: F.shiftrightunsigned(h, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1).cast("long"))
    spread = reps.select("id", "h", F.posexplode(F.array(*[part("h", k) for k in range(most + 1)])).alias("band", "part"))
    full = spread.groupBy("band", "part").agg(F.count("*").alias("n")).filter("n > 1")
    met = spread.join(full, ["band", "part"]).withColumn("parts", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    sides = [met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias(s) for s in ("x", "y")]
    x, y = sides
    where = (F.col("x.band") == F.col("y.band")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own"))
    apart = F.bit_count(F.col("x.h").bitwiseXOR(F.col("y.h")))
    earlier = F.lit(False)
    for k in range(most + 1):
        earlier = earlier | ((F.col("x.band") > k) & (part("x.h", k) == part("y.h", k)))
    near = x.join(y, where & (F.col("x.id") < F.col("y.id")) & (apart <= most) & ~earlier)
    return near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), apart.cast("long").alias("distance"))


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id), (a, b) -> (id, component): smallest id reachable.

    Each round hooks vertices to their smallest neighbours, follows these pointers to their ends and moves the edges
    onto them, so that the living vertices at least halve and a large component is one key in no join of its members.
    """
    live = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("p")))
        while True:
            onward = up.select(F.col("v").alias("p"), F.col("p").alias("far"))
            nxt = cut(up.join(onward, "p").select("v", F.col("far").alias("p"), (F.col("far") != F.col("p")).alias("moved")))
            done = nxt.filter("moved").isEmpty()
            up = nxt.select("v", "p")
            if done:
                break
        rounds.append(up)
        ends = [up.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in ("a", "b")]
        moved = live.join(ends[0], "a").join(ends[1], "b").filter("pa <> pb")
        live = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    out = vertices.select("id", F.col("id").alias("component"))
    for up in rounds:
        out = out.join(up.select(F.col("v").alias("component"), F.col("p").alias("further")), "component", "left").select("id", F.coalesce("further", "component").alias("component"))
    return out


def near_dups(hashes: DataFrame, id: str, hash: str, most: int = 4, text: str | None = None, similar: float = 0.7) -> DataFrame:
    """Groups under Hamming distance: every row with group_id (smallest id), size, keep and distance.

    With `text`, equal normal forms are one exact group whose pairs are no near pairs, though a third row may still join
    them; a near pair whose rows both have text needs a word similarity of `similar` as well. distance is the rounded
    mean over a group's near pairs, null for single rows. Without text, rows of one hash stand for each other and their
    pairs have distance 0.
    """
    if not text:
        pairs = cut(hamming_pairs(hashes, id, hash, most))
        reps = hashes.groupBy(hash).agg(F.min(id).alias("id"))
        comps = connected_components(reps.select("id"), pairs)
        named = hashes.select(id, hash).join(reps, hash).join(comps, "id").select(id, F.col("component").alias("group_id"))
    else:
        # rows alike in hash and text are one class, and classes are paired
        words = F.array_sort(F.array_distinct(F.filter(F.split(normalize(F.coalesce(F.col(text), F.lit(""))), " "), lambda w: w != "")))
        rows = hashes.select(id, F.col(hash).alias("h"), F.coalesce(text_key(F.col(text)), F.lit("")).alias("k"), words.alias("w"))
        classes = cut(rows.groupBy("h", "k").agg(F.min(id).alias("rep"), F.first("w").alias("w")))
        side = lambda x: classes.select(F.col("rep").alias(x), F.col("k").alias(f"k{x}"), F.col("w").alias(f"w{x}"))
        both = hamming_pairs(classes, "rep", "h", most, every=True).join(side("a"), "a").join(side("b"), "b").filter((F.col("ka") != F.col("kb")) | (F.col("ka") == ""))
        alike = (F.col("ka") == "") | (F.col("kb") == "") | (jaccard(F.col("wa"), F.col("wb")) >= similar)
        pairs = cut(both.filter(alike).select("a", "b", "distance"))
        comps = connected_components(classes.select(F.col("rep").alias("id")), pairs)
        alone = rows.join(classes.select("h", "k", "rep"), ["h", "k"])
        # copies of a class are an exact group: without a near pair they stay apart, unless their texts are empty
        near = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().withColumn("_near", F.lit(True))
        named = alone.join(comps, alone["rep"] == comps["id"]).select(alone[id], alone["rep"], alone["k"], "component").join(near, "rep", "left")
        named = named.select(id, F.when(F.col("_near") | (F.col("k") == ""), F.col("component")).otherwise(F.col(id)).alias("group_id"))
    sizes = named.groupBy("group_id").agg(F.count("*").alias("size"))
    where = comps.select(F.col("id").alias("a"), "component")
    mean = pairs.join(where, "a").groupBy(F.col("component").alias("group_id")).agg(F.floor(F.avg("distance") + 0.5).cast("long").alias("distance"))
    return named.join(sizes, "group_id").join(mean, "group_id", "left").select(id, "group_id", "size", (F.col(id) == F.col("group_id")).alias("keep"), "distance")


def jaccard(a: Column, b: Column) -> Column:
    """Of two word arrays: 1 if both are empty, 0 if one is."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y))))


def set_changes(rows: DataFrame, key: list[str], old: str, new: str) -> DataFrame:
    """(key, old, new) of distinct values as arrays -> key, value, change: added or removed; nothing is shuffled."""
    tagged = lambda a, b, name: F.transform(F.array_except(a, b), lambda v: F.struct(v.alias("value"), F.lit(name).alias("change")))
    return rows.select(*key, F.explode(F.concat(tagged(new, old, "added"), tagged(old, new, "removed"))).alias("_c")).select(*key, "_c.*")


def fingerprint_drift(receipt: DataFrame, target: DataFrame, doc: str, page: str = "page_no", content: str = "content", metadata: str = "metadata") -> DataFrame:
    """Page fingerprints (doc, page, content, metadata) of a receipt against a target's, per document: status and the
    sorted pages matched, modified, missing and added.

    identical if all pages agree, metadata_only if their contents do, else content_drift.
    """
    x = receipt.select(doc, page, F.col(content).alias("_c"), F.col(metadata).alias("_m"), F.lit(True).alias("_l"))
    y = target.select(doc, page, F.col(content).alias("_d"), F.col(metadata).alias("_n"), F.lit(True).alias("_r"))
    kind = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "missing").when(~F.col("_c").eqNullSafe(F.col("_d")), "modified").when(F.col("_m").eqNullSafe(F.col("_n")), "matched").otherwise("metadata")
    j = x.join(y, [doc, page], "full_outer").withColumn("_k", kind)
    pages = lambda *ks: F.array_sort(F.collect_list(F.when(F.col("_k").isin(*ks), F.col(page))))
    out = j.groupBy(doc).agg(pages("matched", "metadata").alias("matched"), pages("modified").alias("modified"), pages("missing").alias("missing"), pages("added").alias("added"), F.max((F.col("_k") == "metadata").cast("int")).alias("_meta"))
    same = (F.size("modified") == 0) & (F.size("missing") == 0) & (F.size("added") == 0)
    return out.withColumn("status", F.when(same & (F.col("_meta") == 0), "identical").when(same, "metadata_only").otherwise("content_drift")).drop("_meta")


def drift(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison of (key, value): identical, changed, added or removed."""
    x, y = left.select(key, F.col(value).alias("old"), F.lit(True).alias("_l")), right.select(key, F.col(value).alias("new"), F.lit(True).alias("_r"))
    status = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "identical").otherwise("changed")
    return x.join(y, key, "full_outer").select(key, "old", "new", status.alias("status"))
