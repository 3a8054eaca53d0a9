"""Folioscope: document analytics and hybrid retrieval as PySpark DataFrame programs."""
