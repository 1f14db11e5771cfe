"""Loan-risk analytics as plain DataFrame functions for Apache Spark."""
