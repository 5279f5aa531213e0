"""Source trees and commits as tables."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.functions.text import language_of

#: Folders that hold no sources.
SKIPPED = (".git", "__pycache__", ".venv", "node_modules", ".pytest_cache", ".ai")


def scan_tree(spark: SparkSession, root: str, repository_id: str) -> DataFrame:
    """(repository_id, path, language, content) of the source files below root.

    Folders of SKIPPED and files in no known language are left out, as are those that aren't UTF-8.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    skipped = "|".join(s.replace(".", r"\.") for s in SKIPPED)
    rows = raw.select(path.alias("path"), "content").where(~F.col("path").rlike(rf"(^|/)({skipped})/") & language_of("path").isNotNull())
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return rows.select(F.lit(repository_id).alias("repository_id"), "path", language_of("path").alias("language"), text.alias("content")).where("content is not null")


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


def blobs(repo: str, ids: list[str]) -> Iterator[bytes | None]:
    """The contents of blobs, by one process for all; None for those that aren't there."""
    if not ids:
        return
    with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
        for i in ids:
            p.stdin.write(i.encode() + b"\n")
            p.stdin.flush()
            head = p.stdout.readline().split()
            if len(head) < 3:
                yield None
                continue
            yield p.stdout.read(int(head[2]))
            p.stdout.read(1)
        p.stdin.close()


def full_sha(repo: str, ref: str) -> str:
    """The commit that a name stands for; an error where there is none. Names that look like options are none."""
    if ref.startswith("-"):
        raise ValueError(f"no commit: {ref}")
    return git(repo, "rev-parse", "--verify", "--end-of-options", f"{ref}^{{commit}}").decode().strip()


#: The letters of a raw diff.
STATUS = {"A": "ADDED", "M": "MODIFIED", "D": "DELETED", "R": "RENAMED", "T": "TYPE_CHANGED"}


def raw_changes(data: bytes) -> list[tuple[str, str, str | None, str | None, str | None]]:
    """(path, change_type, previous_path, old_blob_id, new_blob_id) from NUL-separated raw diff records."""
    parts = data.decode("utf-8", "replace").split("\0")
    out, i = [], 0
    while i < len(parts) and parts[i]:
        _, _, old, new, letter = parts[i].lstrip(":").split(" ")
        kind = STATUS.get(letter[0])
        if kind is None:
            raise ValueError(f"unknown status {letter}")
        blank = lambda b: None if set(b) == {"0"} else b
        if letter[0] == "R":
            out.append((parts[i + 2], kind, parts[i + 1], blank(old), blank(new)))
            i += 3
        else:
            out.append((parts[i + 1], kind, None, blank(old), blank(new)))
            i += 2
    return sorted(out)


class _Part(InputPartition):
    def __init__(self, ref: str, k: int = 0):
        self.ref, self.k = ref, k


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repo, self.mode = options["path"], options.get("mode", "files")
        self.slices = max(1, int(options.get("slices", "8")))
        self.refs = [r for r in options.get("commits", "HEAD").split(",") if r]

    def partitions(self) -> list[InputPartition]:
        shas = [full_sha(self.repo, r) for r in self.refs]
        if self.mode == "changes":
            return [_Part(f"{a}..{b}") for a, b in zip(shas, shas[1:])]
        return [_Part(sha, k) for sha in shas for k in range(self.slices)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.mode == "changes":
            a, b = partition.ref.split("..")
            if a != b:
                for row in raw_changes(git(self.repo, "diff-tree", "-r", "-z", "--raw", "-M", "--no-abbrev", a, b)):
                    yield (a, b, *row)
            return
        files = []
        for line in git(self.repo, "ls-tree", "-r", "-z", partition.ref).decode("utf-8", "replace").split("\0"):
            if line:
                head, path = line.split("\t", 1)
                _, kind, blob = head.split(" ")
                if kind == "blob":
                    files.append((path, blob))
        files = files[partition.k :: self.slices]
        for (path, blob), data in zip(files, blobs(self.repo, [b for _, b in files])):
            yield (partition.ref, path, blob, None if data is None else data.decode("utf-8", "replace"))


class GitSource(DataSource):
    """Commits of a local clone. Options: path, commits (comma-separated), mode files or changes.

    files: (commit_sha, path, blob_id, content) of each commit, undecodable bytes replaced. changes: (base_sha,
    target_sha, path, change_type, previous_path, old_blob_id, new_blob_id) between neighbouring commits, renames
    paired; equal commits change nothing. Each commit is read in ``slices`` partitions (8), each by one git process. The clone must lie where executors can
    read it.
    """

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        if self.options.get("mode") == "changes":
            return "base_sha string, target_sha string, path string, change_type string, previous_path string, old_blob_id string, new_blob_id string"
        return "commit_sha string, path string, blob_id string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register_git(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)
