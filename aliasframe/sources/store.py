"""The store: versioned Parquet tables behind one pointer file, identifying columns sealed with AES-GCM.

Every write makes a new version folder and then moves the pointer, so a reader sees a table before or after a write and
never between. The key comes from the caller or the environment and is checked on opening. Set
``spark.sql.redaction.string.regex`` to cover 64-digit hexadecimal strings, so that plan
logs don't show it either.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
SEALED = {"raw_transactions": ("account_id", "raw_payee", "raw_memo", "institution"), "alias_mapping": ("real_value",), "payee_variant": ("variant",)}
KEY_ENV = "ALIASFRAME_KEY"


class Sealed:
    """A secret that shows itself only when asked; printing, pickling and JSON are refused."""

    def __init__(self, value: str):
        self.__value = value

    def reveal(self) -> str:
        return self.__value

    def __repr__(self) -> str:
        return "Sealed(...)"

    def __reduce__(self):
        raise TypeError("a sealed value is not serialised")


class Store:
    def __init__(self, spark: SparkSession, path: str, key: str | None = None, create: bool = False):
        self.spark, self.path = spark, path
        self.key = Sealed(key or os.environ.get(KEY_ENV, ""))
        if not self.key.reveal():
            raise ValueError("a key is needed")
        meta = self._read("store.json")
        mark = hmac.new(hashlib.sha256(self.key.reveal().encode()).digest(), b"aliasframe", "sha256").hexdigest()
        if meta is None:
            if not create:
                raise FileNotFoundError("no store here")
            self._write("store.json", json.dumps({"version": VERSION, "mark": mark}))
        else:
            have = json.loads(meta)
            if have["version"] > VERSION:
                raise ValueError("the store was written by a later version")
            if not hmac.compare_digest(have["mark"], mark):
                raise PermissionError("wrong key")

    def _fs(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _read(self, name: str) -> str | None:
        fs, at = self._fs(name)
        if not fs.exists(at):
            return None
        rows = self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect()  # one small file
        return rows[0][0]

    def _write(self, name: str, text: str) -> None:
        fs, at = self._fs(name)
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _cipher_key(self):
        return F.unhex(F.lit(hashlib.sha256(self.key.reveal().encode()).hexdigest()))

    def _seal(self, name: str, df: DataFrame) -> str:
        """Write the rows, sealed, to a new folder; returns its place in the store."""
        out = df
        for c in SEALED.get(name, ()):
            if c in df.columns:
                mac = F.sha2(F.concat(F.lit(hashlib.sha256(b"mac" + self.key.reveal().encode()).hexdigest()), F.col(c)), 256)
                out = out.withColumn(f"{c}__mac", mac).withColumn(c, F.aes_encrypt(F.col(c), self._cipher_key(), F.lit("GCM")))
        version = f"{name}/v-{uuid.uuid4().hex}"
        out.write.parquet(f"{self.path}/{version}")
        return version

    def write(self, name: str, df: DataFrame) -> None:
        """Replace a table; sealed columns are encrypted, and a keyed hash beside each keeps equality testable."""
        self._write(f"{name}.pointer", self._seal(name, df))

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to a table: they alone are written, and the pointer then names one folder more."""
        before = self._read(f"{name}.pointer")
        self._write(f"{name}.pointer", "\n".join([*(before or "").split(), self._seal(name, df)]))

    def read(self, name: str) -> DataFrame:
        versions = self._read(f"{name}.pointer")
        if versions is None:
            raise FileNotFoundError(f"the store has no {name}")
        df = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{v}" for v in versions.split()])
        for c in SEALED.get(name, ()):
            if c in df.columns:
                df = df.withColumn(c, F.aes_decrypt(F.col(c), self._cipher_key(), F.lit("GCM")).cast("string")).drop(f"{c}__mac")
        return df
