"""Problem 3: records that differ only in formatting.

Bottom-up hashing. A text is a leaf, or a record card: an unordered node of `name: value` fields. Leaves are
normalised (letter case, whitespace, punctuation), a field hashes its two leaves in order, a card sorts the hashes
of its fields, and rows with one root hash are a group. Nested structs, maps and arrays are nodes as well. A full
comparison of the canonical structures confirms each group; groups that fail it are split by structure.

Defined results: null texts are no records (no row in either output); empty or blank texts and texts of punctuation
only are all copies of one another (their canonical form is empty); marks between digits belong to the number, and
digits that stood apart stay apart. Ties: the smallest id is kept. Repeated ids are counted as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from strataq.common import materialise, salted_join, small

_NAME = r"[^\s\d,，;；|｜/、。:：·\\][^\n,，;；|｜。:：]*[:：]"
#: Before a field: any run of separators that is followed by a name and a colon.
_FIELD_START = rf"[\s,，;；|｜/、。·\\]+(?={_NAME})"
_FIELD = rf"(?s)^[\s]*{_NAME}[^。！？!?]*$"
_MARK = r"[\p{P}\p{Z}\p{Cc}\p{Cf}|+<=>~^`$&&[^\u0001-\u0003]]+"
#: A text that doesn't begin with a name and a colon is no card; the test is cheap.
_CARD_HEAD = rf"^\s*{_NAME}"


def leaf(text: Column) -> Column:
    """Letters, digits, marks and symbols of a leaf in lower case; decimal points and hyphens inside numbers stay."""
    t = F.regexp_replace(F.lower(text), r"\.(?<=\d\.)(?=\d)", "\u0001")
    t = F.regexp_replace(t, r"-(?<=\d-)(?=\d)", "\u0002")
    t = F.regexp_replace(t, rf"(\d){_MARK}(?=\d)", "$1\u0003")
    return F.regexp_replace(t, _MARK, "")


def _fields(text: Column) -> Column:
    parts = F.filter(F.split(text, _FIELD_START), lambda p: F.trim(p) != "")
    good = F.filter(F.array(parts), lambda ps: (F.size(ps) >= 2) & F.forall(ps, lambda p: p.rlike(_FIELD)))
    return F.when(text.rlike(_CARD_HEAD), F.try_element_at(good, F.lit(1)))


def _canonical_field(p: Column) -> Column:
    return F.concat(leaf(F.regexp_extract(p, r"(?s)^(.*?)[:：]", 1)), F.lit("\u0004"), leaf(F.regexp_replace(p, r"(?s)^.*?[:：]", "")))


def node(text: Column) -> Column:
    """The children of a text's root: its canonical fields in sorted order after a brace for a card, else its leaf alone."""
    return F.coalesce(F.concat(F.array(F.lit("{")), F.sort_array(F.transform(_fields(text), _canonical_field))), F.array(leaf(text)))


def canonical(kids: Column) -> Column:
    """The normalised structure itself: what two copies share."""
    return F.array_join(kids, "\u0005")


def root_digest(kids: Column) -> Column:
    """Digest of the root node, of the digests of its children."""
    return F.md5(F.array_join(F.transform(kids, lambda k: F.md5(k)), ""))


def record_node(c: Column, kind: DataType) -> Column:
    """The children of any value's root, as an array: structs and maps are unordered nodes of named values, arrays ordered ones.

    Texts are nodes of their own (record cards or leaves); other values are leaves by their text; null is a leaf too.
    """
    if isinstance(kind, StructType):
        fields = [F.concat(F.lit(f.name.lower()), F.lit("\u0004"), _inner(c[f.name], f.dataType)) for f in kind.fields]
        kids = F.concat(F.array(F.lit("{")), F.sort_array(F.array(*fields)))
    elif isinstance(kind, MapType):
        entry = lambda e: F.concat(_inner(e["key"], kind.keyType), F.lit("\u0004"), _inner(e["value"], kind.valueType))
        kids = F.concat(F.array(F.lit("{")), F.sort_array(F.transform(F.map_entries(c), entry)))
    elif isinstance(kind, ArrayType):
        kids = F.concat(F.array(F.lit("[")), F.transform(c, lambda x: _inner(x, kind.elementType)))
    else:
        kids = node(c.cast("string"))
    return F.coalesce(kids, F.array(F.lit("\u0006")))


def _inner(c: Column, kind: DataType) -> Column:
    return F.concat(F.lit("\u000e"), canonical(record_node(c, kind)), F.lit("\u000f"))


def copy_pairs(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(keep_id, copy_id) for every row that is a formatting copy of an earlier one; content is a text or a nested record.

    Digests and structures are made in one pass. The full comparison takes the least and the greatest structure of each
    group, which combine before they move: equal ones prove the whole group, other groups are split by structure.
    """
    content = F.col(content_col)
    kids = record_node(content, df.schema[content_col].dataType)
    nodes = df.where(content.isNotNull()).select(F.col(id_col).alias("rid"), kids.alias("kids"))
    hashed = materialise(nodes.select("rid", root_digest(F.col("kids")).alias("digest"), canonical(F.col("kids")).alias("canon")))
    groups = materialise(hashed.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    few = small(groups)
    # One group may hold a third of all rows: its key is salted where the groups are too many to broadcast.
    members = hashed.join(few, "digest") if few is not groups else salted_join(hashed, groups, "digest", F.col("rid"))
    checked = materialise(members.groupBy("digest").agg(F.min("rid").alias("keep_id"), F.min("canon").alias("a"), F.max("canon").alias("z")).select("digest", "keep_id", F.col("a").eqNullSafe(F.col("z")).alias("same")))
    ids = hashed.select("rid", "digest")
    table = checked.where("same").select("digest", "keep_id")
    hinted = small(table)
    good = ids.join(hinted, "digest") if hinted is not table else salted_join(ids, table, "digest", F.col("rid"))
    pairs = good.where("rid <> keep_id").select("keep_id", F.col("rid").alias("copy_id"))
    # Groups of one digest but several structures: as good as never, so their structures may be keys.
    mixed = hashed.join(small(checked.where("not same").select("digest")), "digest")
    first = mixed.groupBy("digest", "canon").agg(F.min("rid").alias("keep_id"))
    again = mixed.join(first, ["digest", "canon"]).where("rid <> keep_id").select("keep_id", F.col("rid").alias("copy_id"))
    return pairs.unionByName(again).distinct()


def collapse(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct content: keep_id and how many rows carried it (n_copies, itself included)."""
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("keep_id"))
    pairs = materialise(copy_pairs(df, id_col, text_col))
    counts = pairs.groupBy("keep_id").agg(F.count(F.lit(1)).alias("more"))
    kept = rows.join(pairs.select(F.col("copy_id").alias("keep_id")), "keep_id", "left_anti")
    return kept.join(counts, "keep_id", "left").select("keep_id", (F.coalesce("more", F.lit(0)) + 1).alias("n_copies"))
