"""statloom operators"""
