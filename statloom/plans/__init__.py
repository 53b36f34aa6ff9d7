"""statloom plans"""
