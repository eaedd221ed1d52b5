"""What a folder of written parts consists of, entered part by part."""

import json

from pyspark.sql import SparkSession


class Manifest:
    """Numbered entries of a folder; an entry is there as a whole or not at all."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest" + (f"/{name}" if name else ""))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> dict[str, dict]:
        path, fs = self._path()
        if not fs.exists(path):
            return {}
        found = {}
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.endswith(".json"):
                stream = fs.open(status.getPath())
                try:
                    found[name[:-5]] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return found

    def enter(self, name: str, entry: dict) -> None:
        draft, fs = self._path(f"{name}.draft")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        if not fs.rename(draft, self._path(f"{name}.json")[0]) and name not in self.entries():
            raise RuntimeError(f"{self.folder}: entry {name} could not be written")
