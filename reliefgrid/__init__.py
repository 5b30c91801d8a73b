"""Disaster-report analytics on PySpark: text cleaning, tagging, place resolution, counts and views."""
