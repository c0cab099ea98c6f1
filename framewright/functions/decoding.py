"""Image bytes to pixels by Spark's own decoder, that of its ``image`` source.

The source itself takes its files from an index that the driver holds, some kilobytes for
each file. Here the decoder is an expression over a column of bytes, so that files are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession

_DECODER = "org.apache.spark.ml.image.ImageSchema$"


def decoded_image(spark: SparkSession, content: Column) -> Column:
    """The row that the ``image`` source has for a file's bytes: a struct of the struct image (origin, height, width,
    nChannels, mode, data); null for bytes that it cannot decode.

    The expression counts as one that is not deterministic: it is costly, and so neither repeated nor moved.
    """
    from pyspark.sql.classic.column import Column as JvmColumn

    jvm = spark.sparkContext._jvm
    catalyst, types = jvm.org.apache.spark.sql.catalyst, jvm.org.apache.spark.sql.types
    expressions, columns = catalyst.expressions, jvm.org.apache.spark.sql.classic.ExpressionUtils
    literal, cls, no_types = expressions.Literal.fromObject, jvm.java.lang.Class.forName, jvm.PythonUtils.toSeq([])

    def instance(name: str):
        return types.ObjectType(cls(name))

    def call(target, kind, name: str, *arguments):
        given = jvm.PythonUtils.toSeq(list(arguments))
        return expressions.objects.Invoke(target, name, kind, given, no_types, True, True, False)

    def call_static(owner: str, kind, name: str, *arguments):
        given = jvm.PythonUtils.toSeq(list(arguments))
        return expressions.objects.StaticInvoke(
            cls(owner), kind, name, given, no_types, True, True, False, jvm.scala.Option.empty()
        )

    # The decoder is a Scala object, which is found by its static field in each executor.
    owner = call_static("java.lang.Class", instance("java.lang.Class"), "forName", literal(_DECODER))
    field = call(owner, instance("java.lang.reflect.Field"), "getField", literal("MODULE$"))
    decoder = call(field, instance(_DECODER), "get", literal(""))
    found = call(decoder, instance("scala.Option"), "decode", literal(""), columns.expression(content._jc))
    row = expressions.objects.UnwrapOption(instance("org.apache.spark.sql.Row"), found)
    converted = call_static(
        "org.apache.spark.sql.catalyst.CatalystTypeConverters", instance("java.lang.Object"), "convertToCatalyst", row
    )
    # An option that is filled and emptied casts the object to the type it has.
    filled = expressions.objects.WrapOption(converted, instance("java.lang.Object"))
    emptied = expressions.objects.UnwrapOption(jvm.org.apache.spark.ml.image.ImageSchema.imageSchema(), filled)
    return JvmColumn(columns.column(emptied))
