"""The metadata store: tables, column verdicts, policies and audit logs.

Plain catalog tables, so they can be queried with SQL. One writer at a time is
assumed, and any number of readers. Verdicts are kept in generations: a change
writes all verdicts of a table under a new number, then a pointer file, one row of the
table ``column_generations``, makes it the current one. ``columns_metadata`` is the view of what
is current, so a reader sees the verdicts from before or from after a change and never none.
Generations that were replaced stay until :meth:`MetadataStore.vacuum`.

The audit logs are appended to with every scan and read, a small file each. :meth:`MetadataStore.compact_log` writes the
rows of a day's files as one new file and then names the files that it replaces, again by one file renamed into place;
the views ``governance_audit_logs`` and ``policy_engine_audit_logs`` show each row once at any time.

What decides a mask is small and kept by the driver under a token, the names of the files it came from: as long as
nothing has changed, a lookup costs a listing and no job.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions.names import folding
from maskwright.operators.keyed import absent_rows, one_per_key, upsert
from maskwright.operators.policy import AUDIT_SCHEMA, resolve_policies
from maskwright.sources.local import local_frame

SCHEMAS = {
    "tables_metadata": "table_id bigint, table_name string, path string, created_at timestamp",
    "column_versions": "column_name string, sensitivity_tag string, sensitivity_level string, "
    "detection_method string, confidence_score double, reason string, updated_at timestamp, table_id bigint, "
    "generation bigint",
    "roles": "role_name string, role_description string",
    "access_policies": "role_name string, sensitivity_level string, masking_rule string",
    "governance_audit_logs_files": "table_id bigint, table_name string, column_name string, detection_method string, "
    "sensitivity_tag string, sensitivity_level string, confidence_score double, reason string, "
    "scanned_at timestamp, day string, generation bigint",
    "policy_engine_audit_logs_files": AUDIT_SCHEMA + ", day string, generation bigint",
}
#: Log -> the time of its rows.
LOGS = {"governance_audit_logs": "scanned_at", "policy_engine_audit_logs": "executed_at"}
#: Appends by one store object after which it compacts the log of the day.
COMPACT_AFTER = 200
_PARTITIONS = {"column_versions": "PARTITIONED BY (table_id, generation)"} | {
    f"{log}_files": "PARTITIONED BY (day, generation)" for log in LOGS}
_POINTERS = "column_generations"
_COLUMN_KEYS = ["table_id", "column_name"]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; only a local session may fall back to its warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute once and keep the rows on shared storage, safe from lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def table_id_of(name):
    """Stable id of a table name, the same in every session."""
    return F.xxhash64(F.lower(F.trim(name)))


def _names(table: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in SCHEMAS[table].split(",")]


class MetadataStore:
    def __init__(self, spark: SparkSession, database: str = "governance", provider: str = "parquet"):
        self.spark = spark
        self.database = database
        self.provider = provider
        self._folders: dict[str, tuple] = {}
        self._kept: dict[tuple, tuple] = {}
        self._appended: dict[str, int] = {}

    def name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def read(self, table: str) -> DataFrame:
        # The file listing may be cached from before another session's write.
        behind = {"columns_metadata": ("column_versions", _POINTERS)} | {
            log: (f"{log}_files", f"{log}_compactions") for log in LOGS}
        for name in behind.get(table, (table,)):
            self.spark.catalog.refreshTable(self.name(name))
        return self.spark.table(self.name(table))

    def _folder(self, table: str):
        """(file system, folder) of a table; both are the JVM's."""
        if table not in self._folders:
            found = self.spark.sql(f"DESCRIBE FORMATTED {self.name(table)}").filter("col_name = 'Location'").first()
            if found is None:
                raise ValueError(f"Table {self.name(table)} has no folder")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(found.data_type)
            self._folders[table] = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path
        return self._folders[table]

    def _files(self, table: str) -> tuple[str, ...]:
        """The names, sizes and times of a table's files, from a listing of its folder."""
        system, folder = self._folder(table)
        return tuple(sorted(
            f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in system.listStatus(folder) if f.isFile()))

    def generations(self) -> dict[int, int]:
        """The current generation of each table id, as the names of the pointer files tell."""
        system, folder = self._folder(_POINTERS)
        current: dict[int, int] = {}
        for file in system.listStatus(folder):
            name = file.getPath().getName().removesuffix(".csv")
            if not name.startswith((".", "_")):
                table, generation = map(int, name.split("@"))
                current[table] = max(generation, current.get(table, 0))
        return current

    def _publish(self, rows: DataFrame, tables: list[int]) -> int:
        """Write ``rows`` as a new generation of ``tables`` (and of no other), then point to it."""
        generation = self.write_generation(rows)
        self.point_to(generation, tables)
        return generation

    def write_generation(self, rows: DataFrame) -> int:
        """First step of a change: the rows are stored, and nobody reads them yet.

        The number grows and is not used twice, even if a writer fails before the second step."""
        generation = max([time.time_ns() // 1000, *[g + 1 for g in self.generations().values()]])
        self._append("column_versions", rows.withColumn("generation", F.lit(generation).cast("long")))
        return generation

    def point_to(self, generation: int, tables: list[int]) -> None:
        """Second step: a pointer file a table, renamed into place once it is written."""
        for table in tables:
            self._write_file(_POINTERS, f"{table}@{generation}.csv", f"{table},{generation}\n")

    def _write_file(self, table: str, name: str, text: str) -> None:
        """A file of a text table, which is there whole or not at all."""
        system, folder = self._folder(table)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        draft = path(folder, f".{name}")
        out = system.create(draft, True)
        out.write(text.encode())
        out.close()
        if not system.rename(draft, path(folder, name)):
            raise OSError(f"Could not publish {name}")

    def vacuum(self, older_than_seconds: float = 3600.0) -> int:
        """Remove generations that were replaced, or never published, so long ago; returns how many.

        A frame that was read before stays valid that long."""
        current, limit = self.generations(), (time.time() - older_than_seconds) * 1e6
        self.spark.catalog.refreshTable(self.name("column_versions"))
        system, folder = self._folder(_POINTERS)
        gone = 0
        for row in self.spark.sql(f"SHOW PARTITIONS {self.name('column_versions')}").collect():
            table, generation = (int(part.split("=")[1]) for part in row.partition.split("/"))
            if generation < limit and current.get(table) != generation:
                pointer = self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{table}@{generation}.csv")
                system.delete(pointer, False)
                self.spark.sql(f"ALTER TABLE {self.name('column_versions')} DROP IF EXISTS PARTITION (table_id={table}, generation={generation})")
                gone += 1
        return gone

    def _append(self, table: str, rows: DataFrame) -> None:
        rows.select(*_names(table)).write.insertInto(self.name(table))

    def create(self) -> MetadataStore:
        """Create missing tables; seed roles and policies that are absent."""
        self.spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {self.database}")
        for table, schema in SCHEMAS.items():
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({schema}) "
                f"USING {self.provider} {_PARTITIONS.get(table, '')}"
            )
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(_POINTERS)} (table_id bigint, generation bigint) USING csv")
        columns = ", ".join(f"v.{c}" for c in _names("column_versions"))
        self.spark.sql(
            f"CREATE VIEW IF NOT EXISTS {self.name('columns_metadata')} AS SELECT {columns} FROM {self.name('column_versions')} v "
            f"JOIN (SELECT table_id, max(generation) AS generation FROM {self.name(_POINTERS)} GROUP BY table_id) p "
            "ON v.table_id = p.table_id AND v.generation = p.generation")
        for log in LOGS:
            # a file counts if it was appended, or if its compaction was published, and while no compaction names it
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(log)}_compactions (generation bigint, file_name string) USING csv")
            columns = ", ".join(f"f.{c}" for c in _names(f"{log}_files")[:-2])
            self.spark.sql(
                f"CREATE VIEW IF NOT EXISTS {self.name(log)} AS SELECT {columns} FROM "
                f"(SELECT *, _metadata.file_name AS _file FROM {self.name(log)}_files) f "
                f"WHERE (f.generation = 0 OR EXISTS (SELECT 1 FROM {self.name(log)}_compactions g WHERE g.generation = f.generation)) "
                f"AND NOT EXISTS (SELECT 1 FROM {self.name(log)}_compactions r WHERE r.file_name = f._file)")
        seeds = {
            "roles": (V.roles_frame(self.spark), ["role_name"]),
            "access_policies": (V.policies_frame(self.spark), ["role_name", "sensitivity_level"]),
        }
        for table, (rows, keys) in seeds.items():
            missing = absent_rows(self.read(table), rows, keys)
            if not missing.isEmpty():
                self._append(table, missing)
        return self

    def _log(self, log: str, rows: DataFrame) -> None:
        """Append to a log, under the day of its rows; now and then the day's files become one."""
        day = F.date_format(LOGS[log], "yyyy-MM-dd")
        self._append(f"{log}_files", rows.withColumns({"day": day, "generation": F.lit(0).cast("long")}).coalesce(1))
        self._appended[log] = self._appended.get(log, 0) + 1
        if self._appended[log] % COMPACT_AFTER == 0:
            self.compact_log(log)

    def _replaced(self, log: str) -> set[str]:
        self.spark.catalog.refreshTable(f"{self.name(log)}_compactions")
        return {r.file_name for r in self.spark.table(f"{self.name(log)}_compactions").filter("file_name is not null").collect()}

    def compact_log(self, log: str, rows_per_file: int = 1_000_000) -> int:
        """Bring the files of each day together and return how many were replaced.

        The rows are read from the files that are there now, and only these are named as replaced: what others append
        meanwhile stays in files of its own. Days that have one file already are left alone."""
        self.spark.catalog.refreshTable(f"{self.name(log)}_files")
        gone = self._replaced(log)
        files = self.spark.table(f"{self.name(log)}_files").select("day", "generation", F.col("_metadata.file_name").alias("file"))
        days: dict[str, set[str]] = {}
        published = {r.generation for r in self.spark.table(f"{self.name(log)}_compactions").select("generation").distinct().collect()}
        for row in files.distinct().collect():
            if row.file not in gone and (row.generation == 0 or row.generation in published):
                days.setdefault(row.day, set()).add(row.file)
        names = [name for found in days.values() if len(found) > 1 for name in found]
        if not names:
            return 0
        generation = time.time_ns() // 1000
        wanted = local_frame(self.spark, [(n,) for n in names], "_file string")
        source = self.spark.table(f"{self.name(log)}_files").withColumn("_file", F.col("_metadata.file_name"))
        rows = source.join(wanted, "_file").withColumn("generation", F.lit(generation).cast("long"))
        parts = max(1, -(-rows.count() // rows_per_file))
        dealt = rows.withColumn("_part", F.pmod(F.xxhash64("_file"), F.lit(parts)))
        self._append(f"{log}_files", dealt.repartition("day", "_part"))
        self._write_file(f"{log}_compactions", f"{generation}.csv", "".join(f"{generation},{n}\n" for n in names))
        return len(names)

    def vacuum_log(self, log: str, older_than_seconds: float = 3600.0) -> int:
        """Delete the files that compactions replaced so long ago; returns how many."""
        gone, limit = self._replaced(log), (time.time() - older_than_seconds) * 1e3
        system, folder = self._folder(f"{log}_files")
        found, removed = system.listFiles(folder, True), 0
        while found.hasNext():
            file = found.next()
            if file.getPath().getName() in gone and file.getModificationTime() <= limit:
                system.delete(file.getPath(), False)
                removed += 1
        self.spark.catalog.refreshTable(f"{self.name(log)}_files")
        return removed

    def register_tables(self, paths: dict[str, str]) -> None:
        """Register ``name -> path`` where the name is absent; others stay as they are."""
        rows = local_frame(
            self.spark, [(n.strip().lower(), path) for n, path in paths.items()], "table_name string, path string"
        )
        new = one_per_key(rows, ["table_name"], F.col("path"), last=False).select(
            table_id_of(F.col("table_name")).alias("table_id"), "table_name", "path",
            F.current_timestamp().alias("created_at"),
        )
        missing = absent_rows(self.read("tables_metadata"), new, ["table_name"])
        if not missing.isEmpty():
            self._append("tables_metadata", missing)

    def table_names(self) -> list[str]:
        return sorted(self.table_paths())

    def table_paths(self) -> dict[str, str]:
        """Table name -> full name, of every registered table."""
        rows = self.read("tables_metadata").select("table_name", "path").collect()
        return {r.table_name: r.path for r in rows}

    def require_own_names(self, paths: dict[str, str]) -> None:
        """Raise where a name is registered for another path.

        Verdicts are kept by table name: one table's would decide the masks of both."""
        known = self.table_paths()
        for name, path in paths.items():
            before = known.get(name, path)
            if before.lower() != path.lower():
                raise ValueError(f"Table name {name} is registered for {before}; keep {path} in a store of its own")

    def table_id(self, name: str) -> int:
        row = self.read("tables_metadata").filter(F.col("table_name") == name.strip().lower()).first()
        if row is None:
            raise ValueError(f"Table {name} is not registered.")
        return row.table_id

    def upsert_columns(self, verdicts: DataFrame) -> None:
        """Replace or add the verdicts of the scanned columns.

        Other columns of the same tables are carried over; other tables are not
        read at all.
        """
        new = verdicts.select(
            table_id_of(F.col("table_name")).alias("table_id"),
            "column_name", "sensitivity_tag", "sensitivity_level", "detection_method",
            "confidence_score", "reason", F.current_timestamp().alias("updated_at"),
        )
        touched = [r.table_id for r in new.select("table_id").distinct().collect()]
        target = self.read("columns_metadata").filter(F.col("table_id").isin(touched)).drop("generation")
        self._publish(upsert(target, new, _COLUMN_KEYS), touched)

    def append_scan_audit(self, verdicts: DataFrame) -> None:
        self._log("governance_audit_logs", verdicts.select(
            table_id_of(F.col("table_name")).alias("table_id"),
            "table_name", "column_name", "detection_method", "sensitivity_tag", "sensitivity_level",
            "confidence_score", "reason", F.current_timestamp().alias("scanned_at"),
        ))

    def append_access_audit(self, audit: DataFrame) -> None:
        self._log("policy_engine_audit_logs", audit)

    def log_access(self, role: str, reads: dict[str, list[tuple[str, str, str]]]) -> None:
        """One audit row for each table read, in one append; ``reads`` holds (column, action, level) by table.

        The rows are those of :func:`~maskwright.operators.policy.access_audit`, whose inputs are known here."""
        now, rows = int(time.time() * 1e6), []
        for table, columns in reads.items():
            entries = [{"column_name": c, "action": action, "sensitivity_level": level,
                        "is_masked": action not in ("NONE", "CLEAR_TEXT")} for c, action, level in columns]
            context = {"accessed_columns": entries, "total_columns_accessed": len(entries)}
            rows.append((role, table, json.dumps(context, ensure_ascii=False, separators=(",", ":")), now))
        logged = local_frame(self.spark, rows, "user_role string, target_table string, context_details string, at bigint")
        self.append_access_audit(logged.select("*", F.timestamp_micros("at").alias("executed_at")).drop("at"))

    def columns_of(self, table: str) -> DataFrame:
        """Column rows of one table's current generation; both are constants, so one partition is read."""
        table_id = _id(self.spark, table)
        self.spark.catalog.refreshTable(self.name("column_versions"))
        generation = self.generations().get(table_id, -1)
        rows = self.spark.table(self.name("column_versions"))
        return rows.filter((F.col("table_id") == F.lit(table_id)) & (F.col("generation") == F.lit(generation)))

    def _remembered(self, key: tuple, token: tuple, load):
        """``load()``, or what it gave while ``token`` was the same."""
        if key not in self._kept or self._kept[key][0] != token:
            self._kept[key] = token, load()
        return self._kept[key][1]

    def _rules(self) -> dict[tuple[str, str], str]:
        """(role, level) -> masking rule."""
        return self._remembered(("access_policies",), self._files("access_policies"), lambda: {
            (r.role_name, r.sensitivity_level): r.masking_rule for r in self.read("access_policies").collect()})

    def _current_rows(self, table: str) -> list[tuple]:
        """The stored verdicts of one table, as tuples of the columns before ``generation``; bounded by its schema."""
        token = (self.generations().get(_id(self.spark, table)),)
        micros = F.unix_micros("updated_at").alias("updated_at")
        return self._remembered(("columns", table), token, lambda: [
            tuple(r) for r in self.columns_of(table).withColumn("updated_at", micros).drop("generation").collect()])

    def policies_of(self, role: str, table: str, columns: list[str] | None = None) -> list[tuple]:
        """:func:`resolve_policies` of one table as rows on the driver: (table, column, level, rule).

        Looked up anew when the files of the policies or the table's generation changed; else no job runs."""
        name = table.strip().lower()
        if name not in self.known_tables():
            return []
        rules, fold = self._rules(), folding(self.spark)
        wanted = {fold(c) for c in columns} if columns else None
        found = []
        for column, _, level, *_ in self._current_rows(name):
            rule = rules.get((role, level))
            if (wanted is None or fold(column) in wanted) and (level != V.NONE_LEVEL or rule is not None):
                found.append((name, column, level, rule))
        return found

    def known_tables(self) -> dict[str, str]:
        """:meth:`table_paths`, from memory while the registered tables are the same."""
        return self._remembered(("tables_metadata",), self._files("tables_metadata"), self.table_paths)

    def policies_of_all(self, role: str) -> DataFrame:
        """Policies of every registered table, as one plan."""
        return resolve_policies(self.read("columns_metadata"), self.read("tables_metadata"), self.read("access_policies"), role)

    def verdicts(self, table: str) -> DataFrame:
        """Stored verdicts of one table, tag and level in upper case."""
        return fetch_verdicts(self.columns_of(table), self.read("tables_metadata"), table.strip().lower())

    def update_level(self, table: str, column: str, level: str) -> None:
        """Set the level of one column; the next secure read sees it."""
        if level not in V.LEVELS:
            raise ValueError(f"Unknown level: {level}")
        fold, name = folding(self.spark), table.strip().lower()
        table_id, names = _id(self.spark, name), [c for c in _names("column_versions") if c != "generation"]
        place = {c: i for i, c in enumerate(names)}
        rows = [list(r) for r in self._current_rows(name)]
        hits = [r for r in rows if fold(r[place["column_name"]]) == fold(column)]
        if not hits:
            raise ValueError(f"No verdict is stored for column {column} of table {table}")
        for row in hits:
            row[place["sensitivity_level"]] = level
            row[place["updated_at"]] = time.time_ns() // 1000
        rows = [tuple(r) for r in rows]
        schema = SCHEMAS["column_versions"].removesuffix(", generation bigint").replace("updated_at timestamp", "updated_at bigint")
        kept = local_frame(self.spark, rows, schema).withColumn("updated_at", F.timestamp_micros("updated_at"))
        generation = self._publish(kept, [table_id])
        self._kept[("columns", name)] = (generation,), rows


def _id(spark: SparkSession, table: str) -> int:
    """:func:`table_id_of` for a name known here."""
    name = table.strip().lower()
    if name not in _ids:
        _ids[name] = spark.range(1).select(table_id_of(F.lit(name))).first()[0]
    return _ids[name]


_ids: dict[str, int] = {}


def fetch_verdicts(columns_metadata: DataFrame, tables_metadata: DataFrame, table: str) -> DataFrame:
    """Column verdicts of one table, joined by table id."""
    named = tables_metadata.filter(F.col("table_name") == table).select("table_id", "table_name")
    return columns_metadata.join(named, "table_id").select(
        "table_name",
        "column_name",
        F.upper("sensitivity_tag").alias("sensitivity_tag"),
        F.upper("sensitivity_level").alias("sensitivity_level"),
        "detection_method",
        "confidence_score",
    )
