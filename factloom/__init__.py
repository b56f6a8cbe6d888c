"""factloom: Spark jobs for knowledge-bank facts, retrieval, scoring and corpus preparation."""
