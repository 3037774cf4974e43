"""netweave: congested-network analytics and training-data preparation on Spark DataFrames.

Subpackages
-----------
sources     readers and writers (network text files, JSONL result sinks, manifests)
functions   Column expressions (link cost, derivative, caps, formatting)
operators   relational operators over links, demand, flows and records
plans       fixed points and whole queries composed of the operators
streaming   Structured Streaming form of the record sinks
core        data-management operators: compaction, nested records, drift, orphans, profile
llm         text and record operators for training data (optional; nothing else imports it)
"""

__version__ = "0.1.0"
