"""Whole runs: preprocessing, audit, command line, registered queries."""
