"""Loadloom: calendar-cell load disaggregation and corpus operators as Spark plans."""
