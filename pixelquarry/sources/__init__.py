"""Readers that turn folders, files and text into DataFrames."""
