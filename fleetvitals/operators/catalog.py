"""Object sizes, concatenated child rows, and statement text rendered from a catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals.functions import CATALOG_SCOPE, base_name, fill, half_up, quote_name, scope_of
from fleetvitals.operators.filters import LAST_SYSTEM_DATABASE, select_names
from fleetvitals.plans import number_rows

# Pages are 8 KB; object ids up to 255 are internal (fixed values).
PAGE_KB = 8
LAST_INTERNAL_OBJECT = 255


class Catalog(NamedTuple):
    """The catalog relations that sizes are computed from."""

    objects: DataFrame
    indexes: DataFrame
    partitions: DataFrame
    allocation_units: DataFrame
    schemas: DataFrame


def object_sizes(
    catalog: Catalog,
    by_index: bool = False,
    rollup_rows: bool = False,
    last_internal_object: int = LAST_INTERNAL_OBJECT,
) -> DataFrame:
    """Rows, KB per row and size of each table, or of each of its indexes.

    The partition row count is a grouping key, so a table with partitions of unequal size gives several
    rows.  ``rollup_rows=True`` gives one row per table and sums the rows of the table itself.
    A table whose schema is unknown keeps a NULL name.

    Pages are summed per partition, then per index and row count, before the names are joined.
    """
    objects, indexes, partitions, units, schemas = catalog
    unit_scope = scope_of(partitions, units, names=CATALOG_SCOPE)
    pages = units.groupBy(*unit_scope, F.col("container_id").alias("partition_id")).agg(
        F.sum("total_pages").alias("total_pages"), F.sum("used_pages").alias("used_pages")
    )
    part_scope = scope_of(partitions, names=CATALOG_SCOPE)
    counted = partitions.where(F.col("object_id") > last_internal_object)
    if rollup_rows:
        per_index = counted.join(pages, [*unit_scope, "partition_id"]).groupBy(*part_scope, "object_id", "index_id")
        per_index = per_index.agg(
            F.sum(F.when(F.col("index_id") <= 1, F.col("rows")).otherwise(0)).alias("_table_rows"),
            F.sum("rows").alias("_index_rows"),
            F.sum("total_pages").alias("total_pages"),
            F.sum("used_pages").alias("used_pages"),
        )
        per_index = per_index.withColumn("rows", F.col("_index_rows" if by_index else "_table_rows"))
    else:
        per_index = (
            counted.join(pages, [*unit_scope, "partition_id"])
            .groupBy(*part_scope, "object_id", "index_id", "rows")
            .agg(F.sum("total_pages").alias("total_pages"), F.sum("used_pages").alias("used_pages"))
        )
    on_index = [*scope_of(per_index, indexes, names=CATALOG_SCOPE), "object_id", "index_id"]
    named = per_index.join(indexes.select(*on_index, F.col("name").alias("index_name")), on_index)
    on_object = [*scope_of(named, objects, names=CATALOG_SCOPE), "object_id"]
    extra = [c for c in (*CATALOG_SCOPE, "database_name") if c in objects.columns and c not in on_object]
    tables = objects.where(~F.col("is_ms_shipped")).select(
        *on_object, *extra, "schema_id", F.col("name").alias("_table")
    )
    named = named.join(tables, on_object)
    on_schema = [*scope_of(named, schemas, names=CATALOG_SCOPE), "schema_id"]
    named = named.join(schemas.select(*on_schema, F.col("name").alias("_schema")), on_schema, "left")

    tags = [c for c in ("server_id", "captured_at", "database_id", "database_name") if c in named.columns]
    groups = [*tags, "_schema", "_table", *([] if rollup_rows else ["rows"]), *(["index_name"] if by_index else [])]
    sums = [F.sum("total_pages").alias("_total"), F.sum("used_pages").alias("_used")]
    if rollup_rows:
        sums.append(F.sum("rows").alias("rows"))
    sized = named.groupBy(*groups).agg(*sums)
    return sized.select(
        *tags,
        F.concat("_schema", F.lit("."), "_table").alias("table_name"),
        *(["index_name"] if by_index else []),
        "rows",
        half_up(F.col("_total") * PAGE_KB, F.col("rows"), 2, 36).alias("avg_KB_per_row"),
        half_up(F.col("_total") * PAGE_KB, 1024, 2, 36).alias("total_MB"),
        half_up(F.col("_used") * PAGE_KB, 1024, 2, 36).alias("used_MB"),
    )


def object_sizes_all(
    catalog: Catalog,
    databases: DataFrame,
    names: str = "all",
    by_index: bool = False,
    rollup_rows: bool = False,
    last_system_database: int = LAST_SYSTEM_DATABASE,
    last_internal_object: int = LAST_INTERNAL_OBJECT,
) -> DataFrame:
    """Sizes over many databases in one pass, by database, largest first.

    The objects of the catalog carry ``database_id``; ``names`` is ``'all'`` or a comma-separated list.
    """
    picked = select_names(databases, names, last_system_database)
    on = [*scope_of(catalog.objects, databases), "database_id"]
    tagged = catalog.objects.join(picked.select(*on, F.col("name").alias("database_name")), on)
    sizes = object_sizes(catalog._replace(objects=tagged), by_index, rollup_rows, last_internal_object)
    ties = ["table_name", "rows", *(["index_name"] if by_index else [])]
    return sizes.orderBy("database_name", F.desc("total_MB"), *ties)


# Child texts that one task joins at once.
PIECE_TEXTS = 1000


def child_pieces(
    children: DataFrame,
    key: str | Sequence[str],
    text: Column,
    separator: str,
    order: str | Sequence[str],
    name: str = "children",
    piece_texts: int = PIECE_TEXTS,
) -> DataFrame:
    """Joined child texts in numbered pieces: ``piece`` (from 0) and up to ``piece_texts`` texts in order, for a parent of any size.

    Children are numbered in their parent through ranges of (parent, order), so a parent with a third of all
    rows is numbered by many tasks, and its pieces are joined by many tasks.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    kept = children.where(text.isNotNull()).select(*keys, *[F.col(c).alias(f"_by{i}") for i, c in enumerate(order)], text.alias("_text"))
    # equal places are told apart by their texts
    numbered = number_rows(kept, [*[f"_by{i}" for i in range(len(order))], "_text"], within=keys, name="_at")
    piece = (F.col("_at") / F.lit(piece_texts)).cast("bigint").alias("piece")
    listed = numbered.groupBy(*keys, piece).agg(F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("_items"))
    return listed.select(*keys, "piece", F.array_join(F.transform("_items", lambda item: item["_text"]), separator).alias(name))


def join_children(
    children: DataFrame,
    key: str | Sequence[str],
    text: Column,
    separator: str,
    order: str | Sequence[str],
    name: str = "children",
    trailing: bool = False,
) -> DataFrame:
    """One text per parent: its child texts in order, with the separator between them or after each.

    Texts are joined in two steps, first into pieces by many tasks (``child_pieces``), then the pieces of a parent, so the
    last step sees one row per ``PIECE_TEXTS`` children.  The result is a single value per parent, which has to fit
    in one row; for longer ones take the pieces.
    """
    keys = [key] if isinstance(key, str) else list(key)
    pieces = child_pieces(children, keys, text, separator, order, "_text")
    listed = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("piece", "_text"))).alias("_items"))
    joined = F.array_join(F.transform("_items", lambda item: item["_text"]), separator)
    return listed.select(*keys, (F.concat(joined, F.lit(separator)) if trailing else joined).alias(name))


def render(df: DataFrame, templates: Mapping[str, str], **parts: Column | str) -> DataFrame:
    """Add a text column per template; places are filled from the frame's columns or from ``parts``."""
    available = {**{c: F.col(c) for c in df.columns}, **parts}
    return df.withColumns({name: fill(template, **available) for name, template in templates.items()})


# Statement formats (fixed values).
COLLATION_OFFLINE = "ALTER DATABASE {name} SET OFFLINE WITH ROLLBACK IMMEDIATE;"
COLLATION_ATTACH = "CREATE DATABASE {quoted} ON {files} FOR ATTACH;"
COLLATION_ATTACH_FILE = "(FILENAME = N'{physical_name}')"
COLLATION_DETACH = "exec sp_detach_db @dbname = '{name}', @skipchecks = 'true';"
MOVE_BACKUP = "BACKUP DATABASE [{name}] TO DISK = '{backup_share}{name}.bak' WITH INIT, STATS = 5;"
MOVE_OFFLINE = "ALTER DATABASE [{name}] SET OFFLINE WITH ROLLBACK IMMEDIATE;"
MOVE_RESTORE = "RESTORE DATABASE [{name}] FROM DISK = '{backup_folder}{name}.bak' WITH {files}REPLACE, RECOVERY, STATS = 5;"
MOVE_RESTORE_FILE = "MOVE '{name}' TO '{data_folder}{file_name}'"


def _with_files(databases: DataFrame, files: DataFrame) -> DataFrame:
    on = [*scope_of(databases, files), "database_id"]
    return databases.join(files, on, "left")


def collation_scripts(
    databases: DataFrame, master_files: DataFrame, last_system_database: int = LAST_SYSTEM_DATABASE
) -> DataFrame:
    """Offline, attach and detach statements of every user database.  Text only; nothing is run."""
    keys = [*scope_of(master_files), "database_id"]
    piece = fill(COLLATION_ATTACH_FILE, physical_name=F.col("physical_name"))
    files = join_children(master_files, keys, piece, ", ", "file_id", "files")
    user = databases.where(F.col("database_id") > last_system_database)
    texts = render(
        _with_files(user, files),
        {
            "offline_script": COLLATION_OFFLINE,
            "attach_script": COLLATION_ATTACH,
            "detach_script": COLLATION_DETACH,
        },
        quoted=quote_name(F.col("name")),
    )
    return texts.select(
        *scope_of(databases), F.col("name").alias("dbName"), "offline_script", "attach_script", "detach_script"
    )


def move_commands(
    databases: DataFrame, master_files: DataFrame, backup_share: str, backup_folder: str, data_folder: str
) -> DataFrame:
    """Backup, offline and restore statements of the given databases.  Text only; nothing is run.

    The restore statement is NULL for a database without files.
    """
    keys = [*scope_of(master_files), "database_id"]
    piece = fill(
        MOVE_RESTORE_FILE,
        name=F.col("name"),
        data_folder=data_folder,
        file_name=base_name(F.col("physical_name")),
    )
    files = join_children(master_files, keys, piece, ", ", "file_id", "files", trailing=True)
    texts = render(
        _with_files(databases, files),
        {"backup_command": MOVE_BACKUP, "offline_command": MOVE_OFFLINE, "restore_command": MOVE_RESTORE},
        backup_share=backup_share,
        backup_folder=backup_folder,
    )
    return texts.select(
        *scope_of(databases), F.col("name").alias("dbName"), "backup_command", "offline_command", "restore_command"
    )
