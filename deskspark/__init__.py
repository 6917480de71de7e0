"""Support-mail and knowledge-base analytics as Spark DataFrame operators."""
