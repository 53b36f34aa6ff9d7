"""statloom streaming"""
