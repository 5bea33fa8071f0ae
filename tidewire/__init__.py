"""Spark-native table replication: changefeed in, converged tables out."""
