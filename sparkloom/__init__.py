"""sparkloom: retrieval, pipeline and rollout analytics as Spark DataFrame operators."""
