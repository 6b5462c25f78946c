"""kinelake: a Spark-first analytics engine for robot-demonstration corpora."""

__version__ = "0.1.0"
