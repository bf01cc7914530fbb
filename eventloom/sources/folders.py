"""Folders of a shared file system, through the session's own file system classes."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folders:
    def __init__(self, spark: SparkSession) -> None:
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _open(self, path: str):
        place = self._path(path)
        return place.getFileSystem(self._conf), place

    def exists(self, path: str) -> bool:
        system, place = self._open(path)
        return system.exists(place)

    def delete(self, path: str) -> None:
        system, place = self._open(path)
        system.delete(place, True)

    def move(self, path: str, to: str) -> None:
        system, place = self._open(path)
        target = self._path(to)
        system.mkdirs(target.getParent())
        if not system.rename(place, target):
            raise OSError(f"could not move {path} to {to}")

    def swap_in(self, path: str, to: str) -> None:
        """Make the folder `path` the folder `to`; what was there goes only when the new one is complete.

        Readers miss it for the time of two renames, not for that of a write.
        """
        old = None
        if self.exists(to):
            old = f"{path}-old"
            self.move(to, old)
        self.move(path, to)
        if old:
            self.delete(old)
