"""titlegauge: title-performance analytics as Spark DataFrame operators."""
