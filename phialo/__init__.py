"""phialo: drug-safety document jobs as Spark DataFrame transformations."""
