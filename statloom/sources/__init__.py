"""statloom sources"""
