"""The Java class of calls: compiled in the driver's JVM by Janino, which Spark brings along, and sent to the executors as a jar."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_made: dict = {}


def caller(spark: SparkSession):
    """A new Caller.  The class is compiled once for each Spark context."""
    sc = spark.sparkContext
    if sc.applicationId not in _made:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jvm.Thread.currentThread().getContextClassLoader())
        compiler.cook(Path(__file__).with_name("Caller.java").read_text())
        at = f"{os.path.realpath(tempfile.mkdtemp(prefix='tessera-'))}/tessera-{sc.applicationId}.jar"
        with zipfile.ZipFile(at, "w") as jar:
            for name, code in compiler.getBytecodes().items():
                jar.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        sc._jsc.sc().addJar(f"file://{at}")
        _made[sc.applicationId] = compiler.getClassLoader().loadClass("tessera.Caller")
    return _made[sc.applicationId].getDeclaredConstructor(sc._gateway.new_array(sc._jvm.java.lang.Class, 0)).newInstance(sc._gateway.new_array(sc._jvm.java.lang.Object, 0))


def ints(spark: SparkSession, values):
    out = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.int, len(values))
    for i, v in enumerate(values):
        out[i] = int(v)
    return out
