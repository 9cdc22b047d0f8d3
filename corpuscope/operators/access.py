"""Row-level permissions: tag tree, effective tags, visibility, audit of access decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.operators.closure import ancestors
from corpuscope.session import cut_lineage, fits_broadcast, join_on_hot_keys

DEFAULT_TAG = "DEFAULT"
PRIVATE_PREFIX = "PRIVATE_"
PART_BYTES = 5 * 1024 * 1024
#: bitmaps of 4 KB up to which they are broadcast
BROADCAST_BITMAPS = 2_000


def tag_ancestors(tags: DataFrame) -> DataFrame:
    """(tag_id, ancestor, depth) with every tag as its own ancestor at depth 0, however deep the tree."""
    return ancestors(tags, "tag_id", "parent_tag")


def split_tags(csv: Column | str) -> Column:
    value = F.col(csv) if isinstance(csv, str) else csv
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def effective_tags(users: DataFrame, tags: DataFrame) -> DataFrame:
    """(user_id, tag): own tags, all their ancestors and the default tag."""
    own = users.select("user_id", F.explode(split_tags("org_tags")).alias("tag_id"))
    up = tag_ancestors(tags).select("tag_id", F.col("ancestor").alias("tag"))
    inherited = own.join(up, "tag_id", "left").select("user_id", F.coalesce("tag", "tag_id").alias("tag"))
    everyone = users.select("user_id", F.lit(DEFAULT_TAG).alias("tag"))
    return inherited.unionByName(everyone).distinct()


def with_effective_tags(requests: DataFrame, users: DataFrame, tags: DataFrame) -> DataFrame:
    """Add ``user_tags`` (array) to rows that carry ``user_id``; an unknown user has only public rows."""
    wanted = users.join(requests.select("user_id").distinct(), "user_id", "left_semi")
    sets = effective_tags(wanted, tags).groupBy("user_id").agg(F.sort_array(F.collect_set("tag")).alias("user_tags"))
    return requests.join(sets, "user_id", "left").withColumn(
        "user_tags", F.coalesce("user_tags", F.array().cast("array<string>")))


def is_restricted(queries: DataFrame, open_access: bool) -> bool:
    """Whether a search applies permissions. It does unless ``open_access`` says otherwise; rows without an identity are refused."""
    if open_access:
        return False
    missing = {"user_id", "user_tags"} - set(queries.columns)
    if missing:
        raise ValueError(f"a search needs {sorted(missing)} of its user (see with_effective_tags), or open_access=True")
    return True


def visible(user: Column | str = "user_id", user_tags: Column | str = "user_tags", owner: str = "owner_id",
            org_tag: str = "org_tag", is_public: str = "is_public") -> Column:
    """Owner, public, or tagged with one of the user's effective tags. Never null."""
    tags = F.col(user_tags) if isinstance(user_tags, str) else user_tags
    me = F.col(user) if isinstance(user, str) else user
    return (F.coalesce(F.col(owner) == me, F.lit(False)) | F.coalesce(F.col(is_public), F.lit(False))
            | F.coalesce(F.array_contains(tags, F.col(org_tag)), F.lit(False)))


def accessible_files(users: DataFrame, tags: DataFrame, files: DataFrame) -> DataFrame:
    """(user_id, tag, owner_id, doc_id) for all users at once, in no more rows than files and their owners: never one row per user and file, never one join on an OR.

    A row with ``user_id`` is a private file that the user owns. One with ``tag`` is a private file that every holder of the tag sees (``effective_tags``); its ``owner_id`` has it
    as an own file already. A row without either is a public file, the same for everybody.
    """
    private = files.where(~F.coalesce("is_public", F.lit(False)))
    user, tag = (F.lit(None).cast(kind) for kind in (users.schema["user_id"].dataType, "string"))
    owner = F.lit(None).cast(files.schema["owner_id"].dataType).alias("owner_id")
    owned = private.join(users.select("user_id"), F.col("owner_id") == F.col("user_id")).select("user_id", tag.alias("tag"), owner, "doc_id")
    tagged = private.where("org_tag IS NOT NULL").select(user.alias("user_id"), F.col("org_tag").alias("tag"), "owner_id", "doc_id")
    public = files.where("is_public").select(user.alias("user_id"), tag.alias("tag"), owner, "doc_id")
    return owned.unionByName(tagged).unionByName(public)


def accessible_totals(users: DataFrame, tags: DataFrame, found: DataFrame) -> DataFrame:
    """(user_id, n, id_sum): number of private ``accessible_files`` and the sum of their ids, of every user that sees one. Files are added up per tag before tags meet users."""
    both = (F.count("*").alias("n"), F.coalesce(F.sum("doc_id"), F.lit(0)).alias("id_sum"))
    own = found.where("user_id IS NOT NULL").groupBy("user_id").agg(*both)
    tagged = found.where("tag IS NOT NULL").groupBy("tag", "owner_id").agg(*both)
    held = effective_tags(users, tags)
    whole = tagged.groupBy("tag").agg(F.sum("n").alias("n"), F.sum("id_sum").alias("id_sum"))
    through = join_on_hot_keys(held, whole, ["tag"], salt_by=["user_id"]).select("user_id", "n", "id_sum")
    # the own files are counted already
    twice = tagged.withColumnRenamed("owner_id", "user_id").join(held, ["user_id", "tag"]).select("user_id", (-F.col("n")).alias("n"), (-F.col("id_sum")).alias("id_sum"))
    return own.unionByName(through).unionByName(twice).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("id_sum").alias("id_sum"))


def access_bitmaps(users: DataFrame, tags: DataFrame, files: DataFrame) -> DataFrame:
    """(user_id, tags, bucket, seen): bitmaps of documents per block of ids (32,768 of them), one for each owner, each set of tags and the public.

    A row with ``tags`` holds the private documents under exactly these tags (one as a rule), for every user with one of them; a row with ``user_id`` the private documents that a user owns
    and sees through no tag; a row without either the public documents. So the bitmaps grow with the documents and not with the users, and those of one user have no document in common.
    """
    placed = files.select("doc_id", "owner_id", "org_tag", F.coalesce("is_public", F.lit(False)).alias("is_public"))
    spot = (F.expr("bitmap_bucket_number(doc_id)").alias("bucket"), F.expr("bitmap_bit_position(doc_id)").alias("bit"))
    built = F.expr("bitmap_construct_agg(bit)").alias("seen")
    private = placed.where("NOT is_public").groupBy("doc_id").agg(F.sort_array(F.collect_set("org_tag")).alias("tags"), F.collect_set("owner_id").alias("owners"))
    by_tags = private.where(F.size("tags") > 0).select("tags", *spot).groupBy("tags", "bucket").agg(built)
    people = users.select("user_id").distinct()
    owned = private.select(F.explode("owners").alias("user_id"), "tags", "doc_id").join(people, "user_id", "left_semi")
    # what an owner sees through a tag stands there
    asked = owned.select("user_id", "tags").distinct().select("user_id", "tags", F.explode("tags").alias("tag"))
    owners = users.join(asked.select("user_id").distinct(), "user_id", "left_semi")
    covered = asked.join(effective_tags(owners, tags), ["user_id", "tag"]).select("user_id", "tags").distinct()
    by_owner = owned.join(covered, ["user_id", "tags"], "left_anti").select("user_id", *spot).groupBy("user_id", "bucket").agg(built)
    public = placed.where("is_public").select(*spot).groupBy("bucket").agg(built)
    user, none = F.lit(None).cast(users.schema["user_id"].dataType).alias("user_id"), F.lit(None).cast("array<string>").alias("tags")
    rows = by_owner.select("user_id", none, "bucket", "seen").unionByName(by_tags.select(user, "tags", "bucket", "seen")).unionByName(public.select(user, none, "bucket", "seen"))
    return cut_lineage(rows)  # read once for owners, once for tags and once for the public


def visible_counts(users: DataFrame, tags: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(user_id, documents): how many documents every user sees."""
    counted = bitmaps.groupBy("user_id", "tags").agg(F.sum(F.expr("bitmap_count(seen)")).alias("n"))
    own = counted.where("user_id IS NOT NULL").select("user_id", "n")
    tagged = counted.where("tags IS NOT NULL").select("tags", "n", F.explode("tags").alias("tag"))
    through = join_on_hot_keys(effective_tags(users, tags), tagged, ["tag"], salt_by=["user_id"])
    # a user with several tags of a set sees its documents once
    one, many = through.where(F.size("tags") == 1), through.where(F.size("tags") > 1).dropDuplicates(["user_id", "tags"])
    sums = own.unionByName(one.select("user_id", "n")).unionByName(many.select("user_id", "n")).groupBy("user_id").agg(F.sum("n").alias("_own"))
    public = counted.where("user_id IS NULL AND tags IS NULL").select(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return users.select("user_id").join(sums, "user_id", "left").select("user_id", (F.coalesce("_own", F.lit(0)) + public).alias("documents"))


def sees(requests: DataFrame, users: DataFrame, tags: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Add ``visible`` to (user_id, doc_id) requests: the bit of the document in a bitmap of the user, of one of the user's tags or of the public.

    A bitmap is dropped as soon as its bit is read: no row carries one into a shuffle.
    """
    bit = F.expr("bitmap_bit_position(doc_id)").cast("int")
    byte = F.conv(F.hex(F.substring("seen", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.call_function("shiftright", byte, bit % 8).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    asked = requests.withColumn("bucket", F.expr("bitmap_bucket_number(doc_id)"))
    own = bitmaps.where("user_id IS NOT NULL").select("user_id", "bucket", "seen")
    public = bitmaps.where("user_id IS NULL AND tags IS NULL").select("bucket", "seen")
    by_tag = bitmaps.where("tags IS NOT NULL").select(F.explode("tags").alias("tag"), "bucket", "seen")
    pairs = asked.select("user_id", "doc_id", "bucket").distinct()
    wanted = cut_lineage(effective_tags(users.join(pairs.select("user_id").distinct(), "user_id", "left_semi"), tags))
    tagged = join_on_hot_keys(pairs, wanted, ["user_id"], salt_by=["doc_id"])
    few = fits_broadcast(by_tag, BROADCAST_BITMAPS)
    through = join_on_hot_keys(tagged, by_tag, ["tag", "bucket"], salt_by=["user_id", "doc_id"], small_fits=few).where(held).select("user_id", "doc_id").distinct()
    met = asked.join(own, ["user_id", "bucket"], "left").withColumn("_own", held).drop("seen")
    met = met.join(public, "bucket", "left").withColumn("_all", held).drop("seen", "bucket")
    met = met.join(through.withColumn("_tag", F.lit(True)), ["user_id", "doc_id"], "left")
    return met.withColumn("visible", F.col("_own") | F.col("_all") | F.coalesce("_tag", F.lit(False))).drop("_own", "_all", "_tag")


def tag_tree(tags: DataFrame) -> DataFrame:
    """(tag_id, level, path, root, children): roots at level 0, path from the root, child count."""
    up = tag_ancestors(tags)
    ordered = F.sort_array(F.collect_list(F.struct(F.col("depth"), F.col("ancestor"))), asc=False)
    paths = up.groupBy("tag_id").agg(F.max("depth").alias("level"), ordered.alias("chain"))
    children = (tags.where("parent_tag IS NOT NULL").groupBy(F.col("parent_tag").alias("tag_id"))
                .agg(F.count("*").alias("children")))
    return (paths.join(children, "tag_id", "left")
            .select("tag_id", "level", F.array_join(F.transform("chain", lambda n: n["ancestor"]), "/").alias("path"),
                    F.element_at("chain", 1)["ancestor"].alias("root"), F.coalesce("children", F.lit(0)).alias("children")))


def forms_cycle(proposals: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag_id, new_parent, cycle): true when the new parent is the tag itself or one of its descendants."""
    up = tag_ancestors(tags).select(F.col("tag_id").alias("new_parent"), F.col("ancestor").alias("tag_id"),
                                    F.lit(True).alias("_hit"))
    return (proposals.join(up, ["tag_id", "new_parent"], "left")
            .select("tag_id", "new_parent", F.coalesce("_hit", F.lit(False)).alias("cycle")))


def tag_deletability(tags: DataFrame, users: DataFrame, files: DataFrame) -> DataFrame:
    """(tag_id, reason): why a tag cannot be deleted, or 'DELETABLE'."""
    parents = tags.where("parent_tag IS NOT NULL").select(F.col("parent_tag").alias("tag_id")).distinct()
    used = users.select(F.explode(split_tags("org_tags")).alias("tag_id")).distinct()
    primary = users.select(F.col("primary_org").alias("tag_id")).distinct()
    on_files = files.where("org_tag IS NOT NULL").select(F.col("org_tag").alias("tag_id")).distinct()
    out = tags.select("tag_id")
    for flag, side in (("_parent", parents), ("_used", used), ("_primary", primary), ("_files", on_files)):
        out = out.join(side.withColumn(flag, F.lit(True)), "tag_id", "left")
    return out.select(
        "tag_id",
        F.when(F.col("tag_id") == DEFAULT_TAG, "DEFAULT_TAG").when(F.col("_parent"), "HAS_CHILDREN")
        .when(F.col("_used"), "USED_BY_USERS").when(F.col("_primary"), "PRIMARY_TAG")
        .when(F.col("_files"), "USED_BY_FILES").otherwise("DELETABLE").alias("reason"))


def access_decisions(requests: DataFrame, resources: DataFrame, users: DataFrame) -> DataFrame:
    """One decision with its reason per (user_id, doc_id) request; the audit rule, which ignores tag ancestors."""
    found = resources.select("doc_id", "owner_id", "org_tag", "is_public", F.lit(True).alias("_found"))
    who = users.select("user_id", "role", split_tags("org_tags").alias("_tags"), F.lit(True).alias("_known"))
    joined = requests.join(found, "doc_id", "left").join(who, "user_id", "left")
    open_tag = F.col("org_tag").isNull() | F.col("org_tag").isin("", DEFAULT_TAG)
    reason = (
        F.when(F.col("_found").isNull(), "NOT_FOUND")
        .when(F.col("is_public"), "PUBLIC").when(open_tag, "OPEN_TAG")
        .when(F.col("_known").isNull(), "NO_IDENTITY")
        .when(F.col("owner_id") == F.col("user_id"), "OWNER")
        .when(F.col("role") == "ADMIN", "ADMIN")
        .when(F.col("org_tag").startswith(PRIVATE_PREFIX), "PRIVATE_TAG")
        .when(F.size("_tags") == 0, "NO_TAGS")
        .when(F.array_contains("_tags", F.col("org_tag")), "TAG_MATCH").otherwise("TAG_MISMATCH")
    )
    allowed = F.col("reason").isin("PUBLIC", "OPEN_TAG", "OWNER", "ADMIN", "TAG_MATCH")
    return joined.select("user_id", "doc_id", reason.alias("reason")).withColumn("allowed", allowed)


def oversize_uploads(files: DataFrame, users: DataFrame, tags: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Uploads of non-admins above the byte limit of their organisation tag, by the declared size or by what a part shows; a limit of 0 or none is no limit.

    ``parts`` (doc_id, part_index, part_size): a part stands behind ``part_index`` whole ones, so the upload has at least so many bytes. Adds ``estimated_size`` (0 without parts).
    """
    limits = tags.select(F.col("tag_id").alias("org_tag"), "upload_max_size_bytes")
    people = users.select("user_id", "role")
    if parts is None:
        sized = files.withColumn("estimated_size", F.lit(0).cast("long"))
    else:
        seen = parts.groupBy("doc_id").agg(F.max(F.col("part_index") * PART_BYTES + F.col("part_size")).alias("estimated_size"))
        sized = files.join(seen, "doc_id", "left").withColumn("estimated_size", F.coalesce("estimated_size", F.lit(0)).cast("long"))
    over = F.greatest("total_size", "estimated_size") > F.col("upload_max_size_bytes")
    return (sized.join(limits, "org_tag").where((F.col("upload_max_size_bytes") > 0) & over)
            .join(people, "user_id").where(F.col("role") != "ADMIN")
            .select("doc_id", "user_id", "org_tag", "total_size", "estimated_size", "upload_max_size_bytes"))


def list_users(users: DataFrame, *, keyword: str | None = None, tag: str | None = None, role: str | None = None) -> DataFrame:
    """Users that match all given filters (case-insensitive keyword, tag in the csv, role)."""
    out = users
    if keyword:
        out = out.where(F.lower("username").contains(keyword.lower()))
    if tag:
        out = out.where(F.array_contains(split_tags("org_tags"), tag))
    if role:
        out = out.where(F.col("role") == role)
    return out


def quota_managed(user: Column | str) -> Column:
    """Accounts under quota: a non-blank id that does not start with 'system'."""
    value = (F.col(user) if isinstance(user, str) else user).cast("string")
    return F.coalesce((F.trim(value) != "") & ~value.startswith("system"), F.lit(False))


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of every key; the limit is applied before the shuffle as well (window group limit)."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)
