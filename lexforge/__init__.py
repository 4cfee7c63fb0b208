"""lexforge: Spark jobs over large corpora of policy, regulatory and court documents."""
