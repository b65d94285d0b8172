"""Spark-native preparation, modelling and reporting for labelled customer tables."""
