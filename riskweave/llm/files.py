"""Files in the shared folder that Spark has no writer for: atomic commit and streams."""

from __future__ import annotations

from contextlib import contextmanager

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder given as a URI or an absolute path."""
    return fs.FileSystem.from_uri(uri)


@contextmanager
def committed(system: fs.FileSystem, folder: str, name: str, attempt: str):
    """An output stream that appears under ``name`` only when it is whole. A repeated or
    speculative task writes a file of its own and then replaces an equal one."""
    system.create_dir(f"{folder}/_temporary", recursive=True)
    temporary = f"{folder}/_temporary/{name}.{attempt}"
    with system.open_output_stream(temporary, compression=None) as out:
        yield out
    system.move(temporary, f"{folder}/{name}")


def attempt() -> str:
    from pyspark import TaskContext

    context = TaskContext.get()
    return str(context.taskAttemptId()) if context else "0"
