"""cutloom.plans"""
